"""Where documents come from and where they and their views are kept."""
