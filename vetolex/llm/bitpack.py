"""Fixed-width bit packing of token ids.

Every id takes the least number of bits that the vocabulary needs, least significant bit first,
ids back to back.  Ids are stored in blocks of whole documents; a block carries its documents'
ids and the offset of each document in the block, so any document or run of ids is found by
arithmetic and unpacked by a few vectorised numpy steps.  Files are written by Spark (one block a
row, payload as binary), so commits, retries and remote paths are Spark's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


BLOCK_IDS = 1 << 16
BLOCKS = "part int, first long, low long, high long, doc_ids array<long>, offsets array<long>, width int, payload binary"
READ = "part int, at long, doc_id long, n_tokens long, ids_crc32 long"


def width_for(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; reads only the bytes that hold them."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    first = start * width
    raw = np.frombuffer(payload, np.uint8)[first >> 3:((start + count) * width + 7) >> 3]
    if width in (8, 16, 32):
        return raw.view(f"<u{width // 8}").astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = np.arange(count, dtype=np.int64) * width + (first & 7)
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    held = sum(raw[byte + j] << np.uint64(8 * j) for j in range(5))
    return ((held >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of ``source`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends


class PieceEncoder:
    """Ids of whole texts from a byte-level BPE tokenizer, each distinct piece of a batch encoded once.

    The tokenizer splits a text before it merges, and where a single space or line feed stands
    between two other characters, a split always falls before the space and around the line feed;
    in a piece of letters and then marks, one falls between the two.  Texts whose white space is all
    of that kind are therefore cut there, by Arrow, and only distinct runs of letters or marks go to
    the tokenizer's merges.  Any other piece or text goes through the whole tokenizer."""

    #: A text with this has white space of other kinds, or next to other white space, or at an end.
    LOOSE = (r"[\t\r\f\x0b\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
             r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
    #: All of the first class are letters, and none of the second letters, digits or apostrophes, in any version of Unicode.
    PLAIN = (r"\A(?P<feed>\n?)(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]*)(?P<marks>[.,;:!?()#*$%&|<>+=/-]*)\z")
    SLICE = 1 << 20   # pieces that are put together at a time
    BYTES = 8 << 20   # of text in a batch

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        # byte-level BPE spells every byte as one printable character: itself, or one from 256 on
        self.spell = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _merged(self, runs: list[str]) -> tuple[list[int], list[int]]:
        """Ids of runs that the tokenizer does not split, one after the other, and how many each has."""
        ids, sizes, merge, space = [], [], self.tok.model.tokenize, chr(self.spell[32])
        for run in runs:
            spelled = run.replace(" ", space) if run.isascii() else run.encode().decode("latin-1").translate(self.spell)
            found = [t.id for t in merge(spelled)] if run else []
            ids += found
            sizes.append(len(found))
        return ids, sizes

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and starts and sizes in it of three segments (feed, letters, marks) for each piece."""
        text = lambda x: pa.scalar(x, pa.large_string())
        found = pc.extract_regex(pieces, self.PLAIN)
        odd = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        feed, letters, marks = (pc.fill_null(pc.struct_field(found, x), text("")) for x in ("feed", "letters", "marks"))
        fed = pc.equal(feed, text("\n"))
        lead = pc.if_else(fed, text(""), text(" "))
        empty = pc.equal(letters, text(""))
        joined = lambda a, b: pc.binary_join_element_wise(a, b, text(""))
        runs = [pc.if_else(empty, text(""), joined(lead, letters)),
                pc.if_else(pc.and_(empty, pc.not_equal(marks, text(""))), joined(lead, marks), marks)]
        pool, starts, sizes = self._whole("\n"), [np.zeros(len(pieces), np.int64)], [np.asarray(fed).astype(np.int64) * len(self._whole("\n"))]
        for run in runs:
            coded = run.dictionary_encode()
            ids, n = self._merged(coded.dictionary.to_pylist())
            n, at = np.array(n, np.int64), coded.indices.to_numpy()
            starts.append((len(pool) + np.cumsum(n) - n)[at] if len(n) else np.zeros(0, np.int64))
            sizes.append(n[at] if len(n) else np.zeros(0, np.int64))
            pool = pool + ids
        for i in odd.tolist():
            piece = pieces[i].as_py()
            if piece.startswith("\n"):
                own = self._whole("\n") + (self._whole(piece[1:]) if len(piece) > 1 else [])
            else:
                own = self._whole(" " + piece)
            for j in range(3):
                sizes[j][i] = 0
            starts[1][i], sizes[1][i] = len(pool), len(own)
            pool += own
        return np.array(pool, "<u4"), np.stack(starts, 1).ravel(), np.stack(sizes, 1).ravel()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers; some megabytes of text at a time."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + self.BYTES, side="right")))
            yield from self._batch(texts.slice(i, j - i))
            i = j

    def _batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_string())
        loose = pc.match_substring_regex(texts, self.LOOSE)
        tight = texts.filter(pc.invert(loose))
        # a piece follows a space unless it begins with a line feed; the one put before each text is taken off again
        lines = pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\n", pc.replace_substring(tight, "\n", " \n"), "")])
        pieces = pc.split_pattern(lines, " ")
        coded = pieces.flatten().dictionary_encode()
        ids, ends = gathered(*self._pieces(coded.dictionary))
        sizes = np.diff(np.r_[0, ends.reshape(-1, 3)[:, -1]])
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        ends = np.asarray(pieces.offsets)
        ends = ends - ends[0]
        doc, lead = 0, len(self._whole("\n"))

        def together() -> Iterator[np.ndarray]:
            nonlocal doc
            while doc + 1 < len(ends):
                upto = max(doc + 1, int(np.searchsorted(ends, ends[doc] + self.SLICE, side="right")) - 1)
                at = which[ends[doc]:ends[upto]]
                values, total = gathered(ids, starts[at], sizes[at])
                cut = np.r_[0, total][ends[doc:upto + 1] - ends[doc]]
                yield from (values[a + lead:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()))
                doc = upto

        made = together()
        for i, free in enumerate(loose.to_pylist()):
            yield np.array(self._whole(texts[i].as_py()), "<u4") if free else next(made)


def write_packed(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id``, write packed blocks in doc_id order.

    One shuffle, by range of doc_id; each task then encodes and packs its range as a stream, so
    memory holds one block (of one document, if that is longer).  Null ids come first; rows with
    equal or no id follow each other by a hash of the text, then the text, and may be cut between
    tasks, so reruns agree on every place; repeated rows are written as often as they occur; an
    empty table gives a folder without blocks."""
    width = width_for(max(vocabulary, end_id + 1))
    end = np.array([end_id], "<u4")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = PieceEncoder(tokenizer), TaskContext.get().partitionId()
        first, held, raw, lengths, ids = 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal first, held, raw, lengths, ids
            values, known = np.concatenate(raw), [x for x in ids if x is not None]
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()),
                "low": pa.array([min(known, default=None)], pa.int64()), "high": pa.array([max(known, default=None)], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "offsets": pa.array([np.r_[0, np.cumsum(lengths)].tolist()], pa.list_(pa.int64())),
                "width": pa.array([width], pa.int32()), "payload": pa.array([pack(values, width)], pa.binary())})
            first, held, raw, lengths, ids = first + len(values), 0, [], [], []
            return out

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                if held and held + len(own) + 1 > block_ids:
                    yield flush()
                raw += (own, end)
                lengths.append(len(own) + 1)
                ids.append(doc_id)
                held += len(own) + 1
        if ids:
            yield flush()

    (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
     .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
     .mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files.

    ``start`` counts the ids of all documents before it; the files of one folder follow each
    other in the order of ``part``, so the parts' totals (a row each) give the bases."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["offsets"], np.int64)
                ids = unpack(row["payload"], row["width"], 0, int(at[-1])).astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(crc), pa.int32()), "at": pa.array(row["first"] + at[:-1], pa.int64()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())})

    blocks = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (blocks.groupBy("part").agg(F.sum(F.element_at("offsets", -1)).alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (blocks.select(*[c.split()[0] for c in BLOCKS.split(", ")]).mapInArrow(documents, READ)
            .join(F.broadcast(bases), "part")  # one row per written part
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document (once per stored copy).

    Every block stores its least and largest id, which the reader's statistics compare before a list
    of ids or a payload is read."""
    found = (spark.read.parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id)))
             .select("doc_ids", "offsets", "width", "payload").toLocalIterator())
    return [unpack(r["payload"], r["width"], r["offsets"][i], r["offsets"][i + 1] - r["offsets"][i])
            for r in found for i, d in enumerate(r["doc_ids"]) if d == doc_id]
