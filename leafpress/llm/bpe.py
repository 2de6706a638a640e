"""BPE encoding with content-defined chunk reuse, and decoding, for byte-level tokenizers.

A rolling hash over 32 bytes cuts every text into chunks that depend on their content only, so that
copied passages give equal chunks wherever they stand. A chunk is encoded by itself, once, and its
ids serve all documents of the worker that hold it. Near its ends such an encoding may differ from
that of the whole text, so every join is repaired: the stretch from the last safe place before it to
the first one after it is encoded again, together with the words on either side of the stretch. Where
the ids of those words are exactly the chunks' own the join agrees and the stretch is put in; else
both sides move out to the next safe places, until they agree or reach the ends of the text. A safe
place is a blank after a visible ASCII character at which a token of the chunk starts: a pre-token
starts there in any encoding, and no merge crosses it, so agreement means equality with the encoding
of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import texts

#: Mean bytes of a chunk, as a power of two, and the bytes of text that one of a worker's two caches may hold.
CHUNK_BITS, CACHE_BYTES = 9, 12 << 20
#: Beyond so many bytes a piece goes to the library whose pattern engine has no limit on white space.
FAST_BYTES = 1 << 16
#: Fixed value: the pre-token pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True

_loaded: dict[str, Encoder] = {}


def byte_table(tokenizer, suffix: str = "", mark: bytes = b"") -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer; the mark stands for the suffix of a word's last token."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    plain = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        own, end = (token.removesuffix(suffix), mark) if suffix and token.endswith(suffix) else (token, b"")
        out[i] = bytes(plain[c] for c in own) + end if all(c in plain for c in own) else token.encode()
    return out


def ranked(model: dict) -> bool:
    """Whether ids rank the merges: then the lowest id that two neighbours can make is the next merge."""
    made = [model["vocab"].get(m if isinstance(m, str) else "".join(m)) for m in (x.replace(" ", "") if isinstance(x, str) else x for x in model["merges"])]
    return None not in made and all(a < b for a, b in zip(made, made[1:])) and not model.get("dropout") and not model.get("byte_fallback")


def sync_places(buf: np.ndarray) -> np.ndarray:
    """Places of blanks after a visible ASCII character."""
    return np.flatnonzero((buf[1:] == 32) & _VISIBLE[buf[:-1]]) + 1


def chunk_starts(buf: np.ndarray, bits: int) -> np.ndarray:
    """Places, at the start of a character, where the rolling hash of the 32 bytes before has `bits` leading zeros."""
    h = _GEAR[buf]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))  # the right side is built before it is stored
    at = np.flatnonzero(h[:-1] < np.uint32(1 << (32 - bits))) + 1
    return at[(buf[at] & 0xC0) != 0x80]


def merged(*places: np.ndarray) -> np.ndarray:
    """All places in order, each once."""
    every = np.sort(np.concatenate(places))
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


class Encoder:
    """A tokenizer and the chunks that this worker has encoded so far, within a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(self.tokenizer.to_str())
        before = conf["pre_tokenizer"] or {}
        if conf["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("a byte-level tokenizer with the usual pre-token pattern and without a normaliser is needed")
        added = conf["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at what is beside them aren't supported")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        text = byte_table(self.tokenizer)
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        names = [f"{i}," for i in range(len(text))]
        self.width = np.array([len(n) for n in names], np.int64)
        self.names = np.array([list(n.encode().ljust(self.width.max())) for n in names], np.uint8)
        self.fast = None
        if ranked(conf["model"]):
            import tiktoken

            special = set(self.added.values())
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(text) if i not in special}, special_tokens={})
        self.new: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = 0

    @staticmethod
    def load(path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def plain(self, piece: bytes) -> np.ndarray:
        """Ids of a piece that holds no added token."""
        if self.fast is not None and len(piece) <= FAST_BYTES:
            return np.array(self.fast.encode_ordinary(piece.decode()), np.int32)
        return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, np.int32)

    def ids(self, piece: bytes) -> np.ndarray:
        """plain, once for equal pieces: what the newer cache lacks is looked for in the older, which goes when the newer is full."""
        found = self.new.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.plain(piece)
            if self.held > CACHE_BYTES:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[piece] = found
            self.held += len(piece) + 100
        return found

    def run(self, buf: np.ndarray, offs: np.ndarray, bits: int = CHUNK_BITS) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts buf[offs[i]:offs[i+1]], one after another, and the place in them where each text starts."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = buf.tobytes()
        hard, whole = merged(offs), {}
        if self.special and self.special.search(raw):
            # Added tokens are cut out first, and are ends of text for what is beside them.
            whole = {m.start(): m for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for m in self.special.finditer(raw, a, b)}
            hard = merged(offs, np.array([x for m in whole.values() for x in m.span()], offs.dtype))
        inside = np.zeros(len(buf) + 1, bool)
        for m in whole.values():
            inside[m.start() + 1 : m.end()] = True
        cuts = chunk_starts(buf, bits)
        cuts = cuts[~inside[cuts]]
        edges = merged(cuts, hard).tolist()
        parts = [np.array([self.added[whole[x].group()]], np.int32) if x in whole else self.ids(raw[x:y]) for x, y in zip(edges[:-1], edges[1:])]
        ids = np.concatenate(parts)
        ends = np.cumsum(self.size[ids])  # a chunk's ids have the chunk's bytes, so these are places of buf
        joins = cuts[hard[np.searchsorted(hard, cuts)] != cuts]
        if len(joins):
            ids, ends = self._repair(raw, ids, ends, joins, hard, sync_places(buf))
        return ids, np.searchsorted(ends, offs, side="right") if len(ends) else np.zeros(len(offs), np.int64)

    def _repair(self, raw: bytes, ids: np.ndarray, ends: np.ndarray, joins: np.ndarray, hard: np.ndarray, sync: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.zeros(len(raw) + 1, bool)
        starts[ends] = True
        safe = merged(sync[starts[sync]], hard)
        starts[:] = False
        starts[hard] = True
        is_hard = starts[safe]
        # A stretch runs from safe place `left` to safe place `right`; stretches that touch inside a text are one.
        left, right = np.searchsorted(safe, joins, side="left") - 1, np.searchsorted(safe, joins, side="right")
        first = np.concatenate([[True], (left[1:] > right[:-1]) | (left[1:] == right[:-1]) & is_hard[left[1:]]])
        left, right = left[first], np.append(right[:-1][first[1:]], right[-1])
        token = np.where(safe > 0, np.searchsorted(ends, safe) + 1, 0)  # the ids before each safe place
        places, fixed, tok = safe.tolist(), is_hard.tolist(), token.tolist()
        out, upto, done = [], 0, -1
        for a, b in zip(left.tolist(), right.tolist()):
            a = max(a, done)
            if a >= b:  # a stretch that moved out has taken this one in
                continue
            while True:
                wide_a, wide_b = a if fixed[a] or a == done else a - 1, b if fixed[b] else b + 1
                wide = self.ids(raw[places[wide_a] : places[wide_b]])
                head, tail = ids[tok[wide_a] : tok[a]], ids[tok[b] : tok[wide_b]]
                if np.array_equal(wide[: len(head)], head) and np.array_equal(wide[len(wide) - len(tail) :], tail):
                    break
                a, b = wide_a, wide_b
            out += [ids[upto : tok[a]], wide[len(head) : len(wide) - len(tail)]]
            upto, done = tok[b], b
        out.append(ids[upto:])
        ids = np.concatenate(out)
        return ids, np.cumsum(self.size[ids])

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        """For each text its ids in decimal, joined by commas."""
        width = self.width[ids]
        cells = self.names[ids]
        flat = memoryview(cells[cells != 32])
        stops = np.concatenate([[0], np.cumsum(width)])[at].tolist()
        for a, b in zip(stops[:-1], stops[1:]):
            yield flat[a : max(a, b - 1)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> Iterator[str]:
        """For each text the text of its ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        flat = self.bytes[np.repeat(self.start[ids] - stops[:-1], size) + np.arange(stops[-1])].tobytes()
        stops = stops[at].tolist()
        for a, b in zip(stops[:-1], stops[1:]):
            yield flat[a:b].decode(errors="replace")


def _encode(path: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                ids, at = encoder.run(buf, offs, bits)
                a = [hashlib.sha256(x).hexdigest() for x in encoder.decimals(ids, at)]
                b = [hashlib.sha256(x.encode()).hexdigest() for x in encoder.decode(ids, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                ids, at = encoder.run(buf, offs, bits)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), lists, pa.array(list(encoder.decode(ids, at)), pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bpe_encode(docs: DataFrame, tokenizer_path: str, chunk_bits: int = CHUNK_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document. Null and empty texts give no ids.

    The tokenizer must be byte-level with the usual pre-token pattern and no normaliser, and every
    executor must find its file at the path. Repeated rows stay repeated, null ids stay null, other
    columns of the input are not looked at, and an empty table gives no rows.
    """
    return _base(docs, id_col, text_col).mapInArrow(_ids(tokenizer_path, chunk_bits), "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, chunk_bits: int = CHUNK_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode with ids and decoded text as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, whatever its id; one narrow pass without a shuffle.
    """
    return _base(docs, id_col, text_col).mapInArrow(_encode(tokenizer_path, chunk_bits), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
