"""License scans: exact base phrases on words, and a fuzzy search for short notices.

A notice of m bytes may hold up to e errors (insertions, deletions, substitutions). Cut into e + 1
pieces, at least one piece is unhurt (pigeonhole), so the first 8 bytes of every piece are looked up
in the whole text at once by a 64-bit window; only around hits the regex library's bounded-error
matching verifies the notice and reports its span and errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import ALNUM_WORDS, LOWER, texts, words

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by 4.0": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved. no part of this": "proprietary",
}
_SEED = 8
_FOLD = LOWER.copy()
_FOLD[9:14] = 32
_SLOT = np.uint64(0x9E3779B97F4A7C15)

SPANS = "array<struct<label: string, start: long, end: long, errors: int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def errors_allowed(notice: str) -> int:
    """One error in ten bytes, and as many as leave pieces of a seed's length."""
    return min(len(notice) // 10, len(notice) // _SEED - 1)


class _Notices:
    def __init__(self, notices: dict[str, str]):
        self.items = list(notices.items())
        self.patterns, seeds = [], []
        for x, (notice, _) in enumerate(self.items):
            if len(notice) < _SEED or not notice.isascii():
                raise ValueError(f"a notice is ASCII and of {_SEED} characters at least: {notice!r}")
            e = errors_allowed(notice)
            self.patterns.append(regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={e}}}".encode()))
            for i in range(e + 1):
                at = i * len(notice) // (e + 1)
                seeds.append((int(np.frombuffer(notice[at : at + _SEED].encode(), "<u8")[0]), x, at))
        self.seeds: dict[int, list] = {}
        for s, x, at in seeds:
            self.seeds.setdefault(s, []).append((x, at))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(np.array(list(self.seeds), np.uint64) * _SLOT) >> np.uint64(48)] = True

    def hits(self, folded: np.ndarray) -> np.ndarray:
        """Places whose next 8 bytes may be a seed."""
        out = []
        for o in range(min(_SEED, max(0, len(folded) - _SEED + 1))):
            part = folded[o : o + (len(folded) - o) // _SEED * _SEED].view("<u8") if o == 0 else np.frombuffer(folded.tobytes()[o : o + (len(folded) - o) // _SEED * _SEED], "<u8")
            out.append(np.flatnonzero(self.filter[(part * _SLOT) >> np.uint64(48)]) * _SEED + o)
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def spans(self, text: bytes, hits: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(label, first byte, byte after the last, errors), without overlaps of a notice with itself."""
        windows: dict[int, list[list[int]]] = {}
        for h in hits:
            for x, at in self.seeds.get(int.from_bytes(text[h : h + _SEED], "little"), ()):
                e, m = errors_allowed(self.items[x][0]), len(self.items[x][0])
                lo, hi = max(0, int(h) - at - e), int(h) - at + m + e
                rows = windows.setdefault(x, [])
                if rows and lo <= rows[-1][1]:
                    rows[-1][1] = max(rows[-1][1], hi)
                else:
                    rows.append([lo, hi])
        found = []
        for x, rows in windows.items():
            for lo, hi in rows:
                for m in self.patterns[x].finditer(text[lo:hi]):
                    found.append((self.items[x][1], lo + m.start(), lo + m.end(), sum(m.fuzzy_counts), len(self.items[x][0])))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def _scan(base: dict[str, str], notices: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Notices(notices)
        phrases = []
        for phrase, label in base.items():
            raw = np.frombuffer(phrase.encode(), np.uint8)
            phrases.append((words(raw, np.array([0, len(raw)]), ALNUM_WORDS)[1], label))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in texts(batch.column(1)):
                doc, h, _, _ = words(buf, offs, ALNUM_WORDS)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                n = np.diff(at)
                places: list[list[tuple[int, str]]] = [[] for _ in range(hi - lo)]
                for hashes, label in phrases:
                    k = len(hashes)
                    c = np.flatnonzero(h[: len(h) - k + 1] == hashes[0]) if len(h) >= k else np.zeros(0, np.int64)
                    for j in range(1, k):
                        c = c[h[c + j] == hashes[j]]
                    for p in c[doc[c] == doc[c + k - 1]] if len(c) else ():
                        places[doc[p]].append((int(p - at[doc[p]]), label))
                folded = np.ascontiguousarray(_FOLD[buf])
                hits = search.hits(folded)
                cut = np.searchsorted(hits, offs)
                rows = []
                for i in range(hi - lo):
                    spans = []
                    if cut[i + 1] > cut[i]:
                        text = folded[offs[i] : offs[i + 1]].tobytes()
                        raw = buf[offs[i] : offs[i + 1]].tobytes()
                        for label, a, b, errors, length in search.spans(text, hits[cut[i] : cut[i + 1]] - offs[i]):
                            spans.append((label, len(raw[:a].decode(errors="ignore")), len(raw[:b].decode(errors="ignore")), errors, length))
                    own = {label for _, label in places[i]}
                    starts = [p for p, _ in places[i]]
                    score = max([1.0 if own else 0.0, *(1 - s[3] / s[4] for s in spans)])
                    rows.append((ids[lo + i], int(n[i]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score, [dict(zip(("label", "start", "end", "errors"), s)) for s in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and fuzzy notices of every whole text; one narrow pass, no shuffle.

    Returns a row per input row (null ids and repeated rows as they are): doc_id, n_words, n_base
    (places of base phrases), first_word and last_word (least and greatest start, in words from 0;
    null without a place), base_labels and labels (sorted, comma-joined; empty without one), score (1
    for a base phrase, else the best notice's share of unhurt characters, 0 without any), spans (of
    notices, in code points). A null text counts as empty. Overlapping notices are all reported.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan(base, notices), SCHEMA)
