"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

A text is cut into pretokens.  Within a pretoken an Aho-Corasick automaton over
the vocabulary gives the longest token that starts at every byte.  The encoder
takes the longest token that may follow its predecessor, a shorter one where the
pair is incompatible, and steps back where none is left; every position is given
up at most once, so the time is linear.  Two tokens are compatible if merging
their texts by rank would not merge across the border; the verdict of each pair
is kept in a table.  The result is that of applying all merges by rank.

Decoding copies bytes from one array of all tokens' bytes through a table of
offsets, for all ids of a document at once.

Null text is the empty text: no ids, and the digests of the empty string.
Strings of special tokens in a text become their ids, as the tokenizers library
has it by default.  Repeated rows and extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, release, ship, sliced

#: Pretokens: fixed pattern of this tokenizer family, with white space as Unicode defines it.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pretokens a worker remembers, in two halves: a full new half replaces the old one, but for what is met again.
CACHE = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 is itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer of the given JSON definition (byte-level pretokens, no prefix space)."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE definition without prefix space")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        if odd := [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]:
            raise ValueError(f"added tokens that strip, are single words or normalized are not supported: {odd[0]!r}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.text[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        rank_of: dict[int, int] = {}  # by left * size + right
        self.split = [(i, i) for i in range(size)]
        self.rank = [-1] * size  # of the merge that makes a token; single bytes are older than any
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[left + right]
            rank_of[vocab[left] * size + vocab[right]] = rank
            if self.rank[made] < 0:
                self.rank[made], self.split[made] = rank, (vocab[left], vocab[right])
        self.merge_rank = rank_of
        self.automaton = ahocorasick.Automaton()
        special_ids = set(self.special.values())
        by_text = {t: i for i, t in enumerate(self.text) if t and i not in special_ids}
        for t, i in by_text.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.automaton.make_automaton()
        # The next shorter token that is a prefix of a token, or -1.
        self.shorter = [-1] * size
        for t, i in by_text.items():
            self.shorter[i] = next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1)
        self.length = [len(t) for t in self.text]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.text])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.pretoken = regex.compile(PRETOKEN)
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = size
        self.pairs: dict[int, bool] = {}  # by left * size + right
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge across their border comes before those that make them."""
        key = left * self.size + right
        if (known := self.pairs.get(key)) is not None:
            return known
        merge_rank, made, split, size = self.merge_rank, self.rank, self.split, self.size
        a, b, until = left, right, len(merge_rank) + 1
        ra, rb = made[a], made[b]
        while True:
            ok = merge_rank.get(a * size + b, until) >= until
            if not ok or ra < 0 and rb < 0:
                break
            # Undo whichever side was made last; its parts met the border before that.
            if ra > rb:
                until, a = ra, split[a][1]
                ra = made[a]
            else:
                until, b = rb + 1, split[b][0]
                rb = made[b]
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_bytes(self, text: bytes) -> list[int]:
        n = len(text)
        longest = [-1] * n
        # Matches come in the order of their ends: the last of those with one start is the longest.
        for end, (before, token) in self.automaton.iter(text.decode("latin-1")):
            longest[end - before] = token
        given_up = bytearray(n + 1)
        out: list[int] = []
        length, shorter, pairs, size = self.length, self.shorter, self.pairs, self.size
        at, token = 0, longest[0] if n else -1
        while at < n:
            row = out[-1] * size if out else -1
            while token >= 0:
                end = at + length[token]
                if not given_up[end]:
                    if row < 0:
                        break
                    ok = pairs.get(row + token)
                    if ok or ok is None and self.compatible(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("text outside the vocabulary")
                given_up[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def _plain(self, text: str) -> bytes:
        pretokens = self.pretoken.findall(text)
        parts = list(map(self.known.get, pretokens))
        for i in [i for i, ids in enumerate(parts) if ids is None]:
            p = pretokens[i]
            ids = self.known.get(p) or self.older.get(p)
            if ids is None:
                ids = array("i", self.encode_bytes(p.encode())).tobytes()
            if len(self.known) >= CACHE // 2:
                self.older, self.known = self.known, {}
            parts[i] = self.known[p] = ids
        return b"".join(parts)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as int32."""
        if not text:
            return np.zeros(0, np.int32)
        if self.special_pattern is None or not self.special_pattern.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        parts = self.special_pattern.split(text)
        raw = b"".join(np.int32(self.special[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return np.frombuffer(raw, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return gather(ids, self.offsets, self.blob).decode("utf-8", "replace")


#: Texts encoded before their ids leave a worker.
SLICE = 200
#: Ids that ``gather`` expands at once, which bounds its index arrays.
GATHER = 1 << 18


def gather(ids: np.ndarray, offsets: np.ndarray, blob: np.ndarray) -> bytes:
    """The concatenated byte strings of ``ids``."""
    out = []
    for a in range(0, len(ids), GATHER):
        part = ids[a : a + GATHER]
        start = offsets[part]
        length = offsets[part + 1] - start
        ends = np.cumsum(length)
        place = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        out.append(blob[place].tobytes())
    return b"".join(out)


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of ``i,`` for every id: the id list's text is gathered like a decoded one."""
    texts = [f"{i},".encode() for i in range(size)]
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)


_LOADED: dict[str, tuple[Bpe, tuple[np.ndarray, np.ndarray]]] = {}


def loaded(definition: str) -> tuple[Bpe, tuple[np.ndarray, np.ndarray]]:
    """The tokenizer of a definition, built once a task."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _LOADED:
        bpe = Bpe(definition)
        _LOADED.clear()
        _LOADED[key] = bpe, decimal_table(len(bpe.text))
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids``.

    path: the tokenizer's JSON file, read by the driver and broadcast (a few MB,
    whatever the input).  Columns of the input with these names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, (offsets, blob) = loaded(definition.value)
        for part in sliced(texts, SLICE):
            ids = [bpe.encode(t) for t in part.to_pylist()]
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(gather(x, offsets, blob)[:-1]).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.StructArray.from_arrays(columns, made)
        # A worker outlives its tasks: what follows in it needs the memory.
        del bpe
        _LOADED.clear()
        release()

    udf = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids + ">")
    kept = [c for c in docs.columns if c not in (*made, "text", "_p")]
    out = columns_of(docs, *kept, "text").withColumn("_p", udf(F.col("text")))
    return out.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_p.{c}").alias(c) for c in made))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with a ``text`` column made of its ``ids`` (null: null)."""
    spark = encoded.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, _ = loaded(definition.value)
        for part in sliced(batches, SLICE):
            yield pa.array([None if x is None else bpe.decode(np.asarray(x, np.int32)) for x in part.to_pylist()], pa.string())

    return encoded.withColumn("text", F.arrow_udf(run, "string")(F.col("ids")))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return encode_documents(docs, with_ids=False)
