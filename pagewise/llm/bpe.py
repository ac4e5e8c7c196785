"""BPE encoding and decoding with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Stretches without white space, and half of the words, whose encoding a task remembers; beyond that it starts anew.
REMEMBERED = 150_000
#: Characters of the longest one that is remembered: so a full table has a bound in bytes.
REMEMBERED_CHARS = 64
#: Bytes of text in one batch of results.
OUT_BYTES = 2 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in out)}
    return out


class _Known(dict):
    """Answers by key; a new key is answered when it is asked for, a long one each time, and a full table starts anew."""

    def __init__(self, answer, most: int):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, key: str):
        got = self.answer(key)
        if len(key) > REMEMBERED_CHARS:
            return got
        if len(self) >= self.most:
            self.clear()
        self[key] = got
        return got


#: Bits of a symbol's id in a pair of two, and of a place in an entry of the queue.
_ID, _PLACE = 20, 32
_MASK = (1 << _PLACE) - 1


class Bpe:
    """Encodes as the library does for NFC, white space to one space, lower case, a pattern that splits, byte letters and merges with a word end."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        suffix: str = model["end_of_word_suffix"] or ""
        #: By pair of ids: the rank, and the id of what the pair becomes.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[a] << _ID | self.vocab[b], (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.space = regex.compile(r"\p{White_Space}+")
        letters = byte_letters()
        self.first = [self.vocab.get(letters[b]) for b in range(256)]
        self.last = [self.vocab.get(letters[b] + suffix) for b in range(256)]
        self.words = _Known(self.word, 2 * remembered)
        self.known = _Known(self.stretch, remembered)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges by rank, then from the left: a queue of (rank, place) over a doubly linked list.

        An entry is stale, and skipped, where the pair at its place no longer has its rank.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        sym, get = symbols, self.merges.get
        queue = []
        left = sym[0]
        for i in range(n - 1):
            right = sym[i + 1]
            if found := get(left << _ID | right):
                queue.append(found[0] << _PLACE | i)
            left = right
        if not queue:
            return sym
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & _MASK
            j = after[i]
            if j >= n or sym[i] < 0:
                continue
            found = get(sym[i] << _ID | sym[j])
            if not found or found[0] != entry >> _PLACE:
                continue
            sym[i] = new = found[1]
            sym[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := get(new << _ID | sym[k]):
                    push(queue, found[0] << _PLACE | i)
            p = before[i]
            if p >= 0 and (found := get(sym[p] << _ID | new)):
                push(queue, found[0] << _PLACE | p)
        return [s for s in sym if s >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        first = self.first
        symbols = [first[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        return self.merge(symbols if None not in symbols else [x for x in symbols if x is not None])

    def stretch(self, part: str) -> tuple[tuple[int, ...], str]:
        """The ids and the vocabulary strings, joined by spaces, of a lower-case stretch without white space. Words never reach over white space."""
        if part.isalpha():
            ids = tuple(self.words[part])
        elif part[:-1].isalpha() and part[-1] in ",.;:!?":  # most of the others; the pattern would part them so
            ids = (*self.words[part[:-1]], *self.words[part[-1]])
        else:
            ids = tuple(chain.from_iterable([self.words[w] for w in self.split.findall(part)]))
        names = self.names
        return ids, " ".join([names[i] for i in ids])

    def stretches(self, text: str) -> list[str]:
        """The lower-case stretches between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # str.split() takes these for white space
            return [x for x in self.space.sub(" ", text).lower().split(" ") if x]
        return text.lower().split()

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """The answers for each stretch and special token of a text, in order."""
        known = self.known
        if not self.cut or not any(mark in text for mark in self.special):
            return [known[w] for w in self.stretches(text)]
        out: list[tuple[tuple[int, ...], str]] = []
        for part in self.cut.split(text):
            if (special := self.special.get(part)) is not None:
                out.append(((special,), part))
            else:
                out += [known[w] for w in self.stretches(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([ids for ids, _ in self.pieces(text)]))

    def decode(self, ids) -> str:
        """The vocabulary strings, joined as the library joins them when a file names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One Bpe for each vocabulary in a Python worker, with what it remembers."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _encode(path: str, text: str, names: list[str], columns: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)

        def out(part, ids, decoded):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            values = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*names, *columns])

        try:
            for batch in batches:
                first, held = 0, 0
                ids: list[list[int]] = []
                decoded: list[str] = []
                for at in range(0, batch.num_rows, 512):
                    for k, body in enumerate(batch.column(names.index(text)).slice(at, 512).to_pylist(), at):
                        got = bpe.pieces(body or "")
                        ids.append(list(chain.from_iterable([i for i, _ in got])))
                        decoded.append(" ".join([s for i, s in got if i]))
                        held += len(body or "")
                        if held >= OUT_BYTES:
                            yield out(batch.slice(first, k + 1 - first), ids, decoded)
                            first, held, ids, decoded = k + 1, 0, [], []
                if ids:
                    yield out(batch.slice(first), ids, decoded)
        finally:  # an idle worker keeps the vocabulary, but not what it has seen
            bpe.known.clear()
            bpe.words.clear()

    return run


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row of docs with its token ids (array<int>) and the text that they decode to.

    Special tokens that stand in a text are encoded as such; none are added. Null counts as empty: no
    ids, an empty decoded text. Rows that repeat are encoded each; other columns stay, and columns
    named like the two results are replaced.
    """
    docs = docs.drop(ids, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(_encode(path or tokenizer_path(VOCABULARY), text, docs.columns, (ids, decoded)), schema)


def decode_ids(df: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids; a null list gives an empty text, ids outside the vocabulary are passed over."""
    where = path or tokenizer_path(VOCABULARY)
    df = df.drop(decoded)
    names = df.columns

    def run(batches):
        bpe = loaded(where)
        for batch in batches:
            got = [bpe.decode(x.as_py() or ()) for x in batch.column(names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""
    got = encode_texts(docs.select("doc_id", "text"), path).drop("text")
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
