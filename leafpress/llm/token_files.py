"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

A data set is a folder of parts in ascending id order. part-N.bin holds the ids of the part's documents
one after another, in 16 bits where the vocabulary allows it, else 32. part-N.len holds the part's
document ids and lengths, part-N.off the 64-bit offsets of its documents in the whole data set (one
more than documents): base of the part, a prefix sum over parts, plus the running sum inside.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm.bpe import byte_table, ranked
from leafpress.llm.common import LOWER, persist, shuffle_partitions, workdir
from leafpress.llm.ordered import NULL_ID, running_totals

#: Pieces of text whose ids a worker remembers, and words that are encoded in one string.
MEMO, JOINED = 1_000_000, 2000
_SMALL = bytes(LOWER)
#: Between a letter or digit and ASCII punctuation that isn't an apostrophe.
_TAIL = re.compile(rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])")
#: Ends a word in a string of words; no letter.
_MARK = "\x01"
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """A lower-casing tokenizer with word ends, of which each new word is encoded once.

    Blanks and line feeds are never part of a token, so a text's ids are those of the pieces between
    them. A-Z are lowered before a piece is looked up, save where a special token may stand, as the
    tokenizer would do it. Punctuation behind an ASCII letter or digit starts a pre-token, so texts are
    cut there too. New words of letters only are one pre-token each; many are encoded in one string, in
    which a control character ends each word, and told apart by their last token, which carries the
    end-of-word mark. Where ids rank the merges that string goes through the faster of two libraries,
    with the same vocabulary and the control character in place of the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.last[i] = token.endswith("</w>")
        self.fast = None
        conf = json.loads(self.tokenizer.to_str())
        if ranked(conf["model"]) and conf["model"].get("end_of_word_suffix") == "</w>":
            import tiktoken

            added = {t["id"] for t in conf["added_tokens"]}
            pieces = byte_table(self.tokenizer, "</w>", _MARK.encode())
            self.fast = tiktoken.Encoding("own", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks={t: i for i, t in enumerate(pieces) if i not in added}, special_tokens={})
        self.memo: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def load(path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def _each(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)):
                self.memo[p] = np.array(e.ids, self.dtype).tobytes()

    def _words(self, words: list[bytes]) -> None:
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            if self.fast is not None:
                plain = b"".join([p + _MARK.encode() for p in part]).decode()
                ids = np.array(self.fast.encode_ordinary(plain.replace("\u03a3", "\u03c3").lower()), self.dtype)  # no final sigma: letters are lowered one by one
            else:
                ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(part):
                self._each(part)
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist()):
                self.memo[p] = raw[at:end]
                at = end

    def learn(self, new: set[bytes]) -> None:
        words, rest = [], []
        for p in new:
            if p.isalpha():  # of bytes: ASCII letters only
                words.append(p)
                continue
            t = p.decode()
            (words if t.isalpha() and unicodedata.is_normalized("NFC", t) and t.lower().isalpha() else rest).append(p)
        self._words(words)
        self._each(rest)

    @staticmethod
    def cut(text: bytes) -> list[bytes]:
        if b"<|" not in text:
            text = _TAIL.sub(b" ", text.translate(_SMALL))
        return text.replace(b"\n", b" ").split(b" ")

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        lo = 0
        while lo < len(texts):  # runs of about a megabyte
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 20):
                size += len(texts[hi])
                hi += 1
            cut = [self.cut(t) for t in texts[lo:hi]]
            if len(self.memo) > MEMO:
                self.memo = {b"": b""}
            self.learn(set(chain.from_iterable(cut)).difference(self.memo))
            for own in cut:
                yield b"".join(map(self.memo.__getitem__, own))
            lo = hi


def _write(tokenizer: str, folder: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.load(tokenizer)
        tail = np.array([end], encoder.dtype).tobytes()
        context = TaskContext.get()
        part = f"part-{context.partitionId():06d}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = f"{root}/.{part}.{context.taskAttemptId()}"
        docs, lengths, out = [], [], None
        for batch in batches:
            out = out or fs.open_output_stream(f"{own}.bin")
            docs += batch.column(0).to_pylist()
            for ids in encoder.encode(batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()):
                out.write(ids)
                out.write(tail)
                lengths.append(len(ids) // encoder.dtype.itemsize + 1)
        if out is None or not docs:
            return
        out.close()
        with fs.open_output_stream(f"{own}.len") as f:
            f.write(np.array([docs, lengths], "<i8").tobytes())
        for kind in ("bin", "len"):  # the last attempt's files stay; all attempts write the same
            fs.move(f"{own}.{kind}", f"{root}/{part}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([part]), pa.array([len(docs)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([encoder.dtype.itemsize], pa.int32())], names=["part", "name", "docs", "ids", "width"])

    return run


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, docs, base in zip(*(batch.column(c).to_pylist() for c in ("name", "docs", "ids_before"))):
                with fs.open_input_file(f"{root}/{name}.len") as f:
                    lengths = np.frombuffer(f.read(), "<i8").reshape(2, docs)[1]
                with fs.open_output_stream(f"{root}/{name}.off") as f:
                    f.write((base + np.concatenate([[0], np.cumsum(lengths)])).astype("<u8").tobytes())
            yield batch

    return run


def _mapped(fs, path: str) -> pa.Buffer:
    """The file's bytes: mapped where the store is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def _read(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, docs, width in zip(*(batch.column(c).to_pylist() for c in ("name", "docs", "width"))):
                ids = np.frombuffer(_mapped(fs, f"{root}/{name}.bin"), f"<u{width}")
                offs = np.frombuffer(_mapped(fs, f"{root}/{name}.off"), "<u8").astype(np.int64)
                doc_ids = np.frombuffer(_mapped(fs, f"{root}/{name}.len"), "<i8")[:docs]
                for lo in range(0, docs, 4096):
                    at = offs[lo : lo + 4097]
                    own = [ids[a:b].astype("<u4") for a, b in zip(at[:-1] - offs[0], at[1:] - offs[0])]
                    columns = [pa.array(doc_ids[lo : lo + 4096], mask=doc_ids[lo : lo + 4096] == NULL_ID), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the data set and return its parts: part, name, docs, ids, width, ids_before.

    Documents stand in ascending id order (null ids first, equal ids by text); every document, a null or
    empty one too, ends with end_id. An empty table writes nothing and gives no parts. A part is
    written under a name of its attempt and then renamed, so a task that runs twice does no harm. The
    text moves once, by ranges of ids. The folder is a URI that pyarrow can write (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = base.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = persist(ranged.mapInArrow(_write(tokenizer_path, folder, end_id), "part int, name string, docs long, ids long, width int"), "parts")
    based = parts.join(running_totals(parts.select("part", "ids"), "part", "ids"), "part").select("part", "name", "docs", "ids", "width", "ids_before")
    return persist(based.repartition(shuffle_partitions(spark), "part").mapInArrow(_offsets(folder), based.schema), "based")


def read_token_files(parts: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), and the ids if asked, from the mapped files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return parts.repartition(shuffle_partitions(parts.sparkSession), "part").mapInArrow(_read(folder, with_ids), schema)


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    folder = workdir(spark, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)
