"""Token ids in files: frequency-ranked, byte-aligned, with the control bytes apart from the data.

File: the 8 bytes of MAGIC, then blocks up to the end. A block is four little-endian unsigned 32-bit integers
(entries, tokens, control bytes, data bytes), then for the entries their ids (int64), token counts (uint32) and flags
(uint8: 1 the id is null, 2 the document goes on in the next block), then the control and the data bytes.
Ids are replaced by their rank by frequency over the whole corpus, so the commonest 256 take one byte. A control byte
holds the lengths (less one, two bits each, the first lowest) of four ranks; the data bytes are the ranks themselves,
little-endian without leading zeros.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, attempt_name, map_rows, qualified, scratch, slices, small_batches, written
from .pieces import Vocabulary, byte_chars, default_vocabulary

#: Fixed value: what a token file starts with.
MAGIC = b"RANKVB1\n"
#: Tokens in a block, and distinct pieces that a worker keeps encoded.
BLOCK, PIECES = 1 << 16, 900_000
#: New pieces that go through the library as one text.
JOINED = 2000
END = 2

_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3
_MASKS = (np.arange(4) <= _LENGTHS[:, :, None]).reshape(256, 16)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    r = ranks.astype("<u4")
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        codes[: len(r)] += r > limit
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    held = np.arange(4, dtype=np.uint8) <= codes[: len(r), None]
    return control.sum(1, dtype=np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[held].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again: each control byte looks up which bytes of its four ranks the data has."""
    held = _MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[held] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


class LibraryEncoder:
    """Ids by the tokenizers library. Byte-level BPE never merges across pieces, so each distinct piece goes through
    the library once; other kinds of tokenizer get whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kind = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        try:
            vocabulary = Vocabulary(path)
            self.pieces, self.sizes = vocabulary.pieces, np.array([len(t) for t in vocabulary.bytes])
            self.model = Tokenizer(self.lib.model)
            self.model.pre_tokenizer = CharDelimiterSplit("\n")
            self.stand_in = {b: c for c, b in byte_chars().items() if b != 10}
        except (ValueError, KeyError):
            self.pieces = None
        self.known: dict[str, bytes] = {}

    def _through(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Pieces that are a space and letters go through the library's model line by line, their bytes written as the
        vocabulary does, as the library needn't split them again; the ids of each end where its bytes do."""
        lined, rest = [], []
        for p in new:
            (lined if p[0] == " " and p[1:].isalpha() else rest).append(p)
        self.known.update(zip(rest, self._through(rest), strict=True))
        if lined:
            texts = ["\n".join(lined[at : at + JOINED]).encode().decode("latin-1").translate(self.stand_in) for at in range(0, len(lined), JOINED)]
            raw = b"".join([np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum([len(p.encode()) for p in lined])
            after = np.cumsum(self.sizes[np.frombuffer(raw, self.kind)])
            cuts = np.searchsorted(after, ends) + 1
            if (after[cuts - 1] != ends).any():
                self.known.update(zip(lined, self._through(lined), strict=True))
                return
            width, at = np.dtype(self.kind).itemsize, 0
            for p, cut in zip(lined, (cuts * width).tolist(), strict=True):
                self.known[p] = raw[at:cut]
                at = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.pieces is None:
            return self._through(texts)
        split = [self.pieces(t) for t in texts]
        distinct = set().union(*split) if split else set()
        known = self.known
        if len(known) + len(distinct) > PIECES:  # those in use stay
            known = self.known = {p: known[p] for p in distinct if p in known}
        new = list(distinct.difference(known))
        if new:
            self._learn(new)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> LibraryEncoder:
    """One for all tasks of a worker: what one task has encoded, the next knows."""
    return LibraryEncoder(path)


class _Writer:
    def __init__(self, out, rank: np.ndarray):
        self.out, self.rank, self.entries, self.tokens, self.held = out, rank, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        flag = int(doc_id is None)
        while True:
            part = ids[: BLOCK - self.held]
            ids = ids[len(part) :]
            self.entries.append((doc_id or 0, len(part), flag | 2 * bool(len(ids))))
            self.tokens.append(part)
            self.held += len(part)
            if self.held >= BLOCK:
                self.flush()
            if not len(ids):
                return

    def flush(self) -> None:
        if not self.entries:
            return
        control, data = pack(self.rank[np.concatenate(self.tokens)])
        names, counts, flags = zip(*self.entries, strict=True)
        self.out.write(struct.pack("<4I", len(names), self.held, len(control), len(data)))
        for column, kind in ((names, "<i8"), (counts, "<u4"), (flags, "u1")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(control)
        self.out.write(data)
        self.entries, self.tokens, self.held = [], [], 0


def read_file(source, by_rank: np.ndarray):
    """(id, ids, whether the document ends here) of each entry of an open file, in order."""
    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(16):
        entries, tokens, controls, data = struct.unpack("<4I", head)
        names = np.frombuffer(source.read(8 * entries), "<i8").tolist()
        counts = np.frombuffer(source.read(4 * entries), "<u4").tolist()
        flags = source.read(entries)
        control = source.read(controls)
        ids = by_rank[unpack(control, source.read(data), tokens)]
        at = 0
        for name, n, flag in zip(names, counts, flags, strict=True):
            yield (None if flag & 1 else name), ids[at : at + n], not flag & 2
            at += n


def encode_table(docs: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """(doc_id, seq, ids) of every text, written to the shared folder; seq tells repeated rows apart."""

    def make():
        from pyspark import TaskContext

        coder, at = worker_encoder(path), [TaskContext.get().partitionId() << 33]
        last = np.array([end], coder.kind).tobytes()

        def step(columns):
            first = at[0]
            at[0] += len(columns[0])
            return [columns[0], list(range(first, at[0])), [x + last for x in coder([t or "" for t in columns[1]])]]

        return step

    return written(map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, seq long, ids binary"), "token-ids")


def rank_ids(encoded: DataFrame, size: int) -> np.ndarray:
    """All ids by falling frequency over every document, then by id. At most as long as the vocabulary."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def count(batches):
        sums = np.zeros(size, np.int64)
        for (ids,) in slices(batches):
            sums += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.int64())], ["id", "n"])

    rows = small_batches(encoded.select("ids")).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(size, np.int64)
    sums[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.lexsort((np.arange(size), -sums)).astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> list[dict]:
    """Writes the ids of every text, each followed by end, in ascending order of id_col, to files in folder.

    Returns the manifest, one entry per file in order: file, start (ids in the files before it), docs, tokens; it is also
    in folder as manifest.json, the ranked ids as ranks.npy. Nulls: a null text is empty (only the end id); null ids
    come first. Repeated ids keep all rows, in the order they were read. A document may span blocks, so texts of any
    length fit. An empty table writes no file but the two. Files are named by task attempt and count once the manifest
    names them, so a lost executor leaves at most files that nobody reads.
    """
    import io
    import json

    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or default_vocabulary()
    folder = qualified(spark, folder)
    size = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    encoded = encode_table(docs, id_col, text_col, path, end)
    by_rank = rank_ids(encoded, size)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)

    def write(batches):
        files, writer, name, out = Files(folder), None, attempt_name("tokens"), None
        first, docs_n, tokens = None, 0, 0
        for names, seqs, ids in slices(batches):
            if writer is None:
                out = files.create(name)
                writer, first = _Writer(out, rank), (names[0], seqs[0])
            for doc_id, x in zip(names, ids, strict=True):
                found = np.frombuffer(x, kind)
                writer.add(doc_id, found)
                docs_n, tokens = docs_n + 1, tokens + len(found)
        if writer is not None:
            writer.flush()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_id": first[0], "first_seq": first[1], "docs": docs_n, "tokens": tokens}], schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("first_seq", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered = encoded.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq")
    rows = small_batches(ordered).mapInArrow(write, "file string, first_id long, first_seq long, docs long, tokens long").collect()  # a row per file
    rows.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_seq))
    manifest, start = [], 0
    for r in rows:
        manifest.append({"file": r.file, "start": start, "docs": r.docs, "tokens": r.tokens})
        start += r.tokens
    files, raw = Files(folder), io.BytesIO()
    np.save(raw, by_rank)
    for name, content in (("ranks.npy", raw.getvalue()), ("manifest.json", json.dumps(manifest).encode())):
        with files.create(name) as f:
            f.write(content)
    return manifest


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, read from the files that the manifest names."""
    import io
    import json

    folder = qualified(spark, folder)
    files = Files(folder)
    with files.open("manifest.json") as f:
        manifest = json.loads(f.read())
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(max(1, len(manifest)))

    def read(batches):
        files = Files(folder)
        with files.open("ranks.npy") as f:
            by_rank = np.load(io.BytesIO(f.read()))
        for batch in batches:
            for name, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with files.open(name) as f:
                    out, n, crc, held, size = [], 0, 0, [], 0
                    for doc_id, ids, ends in read_file(f, by_rank):
                        raw = ids.astype("<u4").tobytes()
                        n, crc = n + len(ids), zlib.crc32(raw, crc)
                        if with_ids:
                            held.append(raw)
                        if not ends:
                            continue
                        out.append((doc_id, start, n, crc, *([b"".join(held)] * with_ids)))
                        size += 4 * n
                        start, n, crc, held = start + n, 0, 0, []
                        if len(out) >= 4096 or (with_ids and size > 8 << 20):
                            yield _rows(out)
                            out, size = [], 0
                    if out:
                        yield _rows(out)

    def _rows(out):
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return names.mapInArrow(read, fields)


def op3(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder)
