"""Operator 2, token ids on disk: canonical length-limited Huffman codes from global counts.

A corpus folder holds one file per range of ids and a manifest of their blocks. A block holds whole
documents and can be read alone: its header names ids and token counts, a checkpoint gives the bit
offset of every ``STRIDE``-th token, and the file's header holds the code lengths. Checkpoints let a
reader decode all strides of many blocks side by side, one table lookup per step for each of them.

    file   = b"WLTOK1\\0\\0", u32 end id, u32 n, u32 size of the packed lengths, zlib(u8 code length of ids 0..n-1), blocks
    block  = u32 documents, u32 tokens, u32 stride, u32 payload bytes, u32 crc32 of the payload,
             i64 ids, u8 null flags of the ids, u32 token counts, u32 checkpoints, payload (big-endian bits)

Each document begins at a whole byte and has checkpoints of its own, one per ``STRIDE`` tokens. All integers little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import blobs, bytes_of, discard, texts_of

MAGIC = b"WLTOK1\0\0"
STRIDE = 128
BLOCK_TOKENS = 1 << 16
LIMIT = 16
STORE_WORDS = 1_200_000


# Encoding of texts ----------------------------------------------------------------------------


SIGNS = "[!-&(-/:-@\\[-`{-~]+"
PIECE = f"[a-zß-öø-ÿ]+|[0-9]|{SIGNS}"


def _listed(column: pa.Array) -> list:
    """As ``to_pylist``, several times as fast for strings."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Token ids of whole texts by a tokenizer file.

    ``by_word``: for tokenizers that drop white space and case, never join across white space and mark
    the end of each word (letters, a digit, or a run of other signs). The library then encodes every
    word once and its ids are looked up afterwards; results equal those of whole texts. Words of plain
    Latin letters, digits and ASCII signs need no normalising and are given to the model without it.
    Texts with combining marks or with the beginning of a special token are encoded whole. The store
    of words is emptied when it is full, so memory is bounded.
    """

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.tok, self.by_word = Tokenizer.from_file(path), by_word
        if by_word:
            self.lean = Tokenizer.from_file(path)
            self.lean.normalizer = normalizers.Sequence([])
            self.lean.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            suffix = self.tok.model.end_of_word_suffix
            vocab = self.tok.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.piece = re.compile(PIECE)
            self.plain = re.compile(f"(?:{PIECE})+")
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words in a row, and how many each has."""
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.at[which] - (ends - size), size) + np.arange(total)], size

    def _raw(self, texts: list[bytes]) -> list[list[int]]:
        batch = [t.decode("utf-8", "replace") for t in texts]
        return [e.ids for e in self.tok.encode_batch_fast(batch, add_special_tokens=False)]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; new ones are learnt."""
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = list(map(words.__getitem__, new.tolist()))
            number[new] = base = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, base.tolist()))
            self._learn(fresh, base)
        return number

    def _learn(self, fresh: list[bytes], number: np.ndarray) -> None:
        """Ids of new words: plain ones by their pieces, others as the library takes them."""
        self.at = np.concatenate([self.at, np.zeros(len(fresh), np.int64)])
        self.size = np.concatenate([self.size, np.zeros(len(fresh), np.int64)])
        words = blobs(fresh).view(pa.string())
        leaf = pc.match_substring_regex(words, f"^(?:{PIECE})$").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, f"^(?:{PIECE})+$").to_numpy(zero_copy_only=False) & ~leaf
        texts, leaves, odd, joined, parts = _listed(words.filter(pa.array(leaf))), number[leaf].tolist(), [], [], []
        for i in np.flatnonzero(~(leaf | plain)).tolist():
            u = fresh[i].decode("utf-8", "replace").lower()
            if not self.plain.fullmatch(u):
                odd.append(i)
            elif len(ps := self.piece.findall(u)) == 1:
                leaves.append(number[i]), texts.append(u)
            else:
                joined.append(i), parts.append(ps)
        rows = [" ".join(texts[i : i + 400]) for i in range(0, len(texts), 400)]
        ids = [np.asarray(e.ids, np.uint32) for e in self.lean.encode_batch_fast(rows, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(leaves):
            raise ValueError("this tokenizer does not mark the end of words; use by_word=False")
        self._put(np.array(leaves, np.int64), flat, np.diff(np.concatenate(([0], ends))))
        ids = self._raw([fresh[i] for i in odd])
        size = np.array([len(x) for x in ids], np.int64)
        self._put(number[odd], np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum())), size)
        cut = pc.replace_substring_regex(words.filter(pa.array(plain)), f"({PIECE})", "\\1 ")
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        self._put_joined(number[plain], pc.list_value_length(cut), cut.flatten())
        self._put_joined(number[joined], pa.array([len(p) for p in parts], pa.int32()), pa.array(list(chain.from_iterable(parts)), pa.string()))

    def _put_joined(self, which: np.ndarray, n: pa.Array, pieces: pa.Array) -> None:
        """Words that consist of ``n`` pieces each, all pieces in a row."""
        if len(which):
            n = n.to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pieces.view(pa.binary()).dictionary_encode()
            flat, size = self._gather(self._numbers(_listed(coded.dictionary))[coded.indices.to_numpy()])
            self._put(which, flat, np.add.reduceat(size, np.cumsum(n) - n))

    def _put(self, which: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.at[which], self.size[which] = len(self.pool) + np.cumsum(size) - size, size
        self.pool = np.concatenate([self.pool, ids])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, tokens per text)."""
        whole = np.array([not self.by_word or b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts], bool)
        if not whole.any():
            return self._by_words(texts)
        alone = [np.asarray(x, np.uint32) for x in self._raw([t for t, x in zip(texts, whole) if x])]
        flat, n = self._by_words([t for t, x in zip(texts, whole) if not x])
        others = np.split(flat, np.cumsum(n))
        turns = [iter(others), iter(alone)]
        ids = [next(turns[int(x)]) for x in whole]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words are split and numbered by Arrow: Python meets each distinct word of a run once.

        White space at an end of a text gives an empty word, which has no ids.
        """
        if len(self.at) > STORE_WORDS:
            self._empty()
        words = pc.ascii_split_whitespace(pc.ascii_lower(blobs(texts).view(pa.string())))
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().view(pa.binary()).dictionary_encode()
        flat, size = self._gather(self._numbers(_listed(coded.dictionary))[coded.indices.to_numpy()])
        last = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n)]
        return flat, np.diff(np.concatenate(([0], last)))


def encoder_of(path: str, by_word: bool) -> Encoder:
    """The encoder of this Python worker; it outlives the task, as the code of a task does not."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if (path, by_word) not in kept:
        kept[path, by_word] = Encoder(path, by_word)
    return kept[path, by_word]


def _with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(flat, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


# Codes ----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur.

    The limit is raised to what the number of ids needs. A single id gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        even = row[: len(row) // 2 * 2]
        merged = np.concatenate([leaves, even[0::2] + even[1::2]])
        by = np.argsort(merged, kind="stable")
        row = merged[by]
        kinds.append(by < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


class Codec:
    """Vectorised coder and table-driven decoder of the canonical codes of one set of code lengths.

    Codes follow each other in order of (length, id), so their starts in the table of all ``width``-bit
    strings are running sums.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.width = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))[np.count_nonzero(lengths == 0) :]
        size = lengths[order].astype(np.int64)
        room = 1 << (self.width - size)
        self.cell = 2 if self.width <= 16 else 4  # bytes that a code is written from
        self.left = np.zeros(len(lengths), np.uint64)
        self.left[order] = (np.cumsum(room) - room) << (8 * self.cell - self.width)
        self.symbol, self.step = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.uint8)
        self.symbol[: room.sum()], self.step[: room.sum()] = np.repeat(order, room), np.repeat(size, room)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Per document its bits, filled up to whole bytes, and the bit offsets of every STRIDE-th id (u32)."""
        size = self.lengths[ids].astype(np.int64)
        at = np.cumsum(size) - size
        firsts = np.cumsum(counts) - counts
        total = np.diff(np.concatenate((at, [size.sum()]))[np.append(firsts, len(ids))])
        cuts = np.concatenate(([0], np.cumsum((total + 7) // 8)))
        at += np.repeat(8 * cuts[:-1] - (np.cumsum(total) - total), counts)  # a document begins at a whole byte
        raw = self._bits(self.left[ids], at, int(cuts[-1]))
        strides = -(-counts // STRIDE)
        ends = np.cumsum(strides)
        rank = np.arange(int(strides.sum())) - np.repeat(ends - strides, strides)
        marks = at[np.repeat(firsts, strides) + STRIDE * rank] - np.repeat(8 * cuts[:-1], strides)
        marks, ends = marks.astype("<u4").tobytes(), np.concatenate(([0], 4 * ends)).tolist()
        cuts = cuts.tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])], [marks[a:b] for a, b in zip(ends, ends[1:])]

    def _bits(self, left: np.ndarray, at: np.ndarray, size: int) -> bytes:
        """Codes laid down at their ascending bit offsets: those that begin in one 32-bit cell are added up in 64 bits,
        whose lower half belongs to the next cell."""
        out = np.zeros(size // 4 + 2, np.uint32)
        if len(at):
            cell = at >> 5
            value = left << (np.uint64(64 - 8 * self.cell) - (at & 31).astype(np.uint64))
            begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            value, cell = np.add.reduceat(value, begins), cell[begins]
            out[cell] = (value >> np.uint64(32)).astype(np.uint32)
            out[cell + 1] += value.astype(np.uint32)
        return out.astype(">u4").tobytes()[:size]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of blocks (bits, checkpoints, tokens from each checkpoint); all strides of all blocks advance together."""
        room = np.cumsum([0, *[len(b) + 8 for b, _, _ in blocks]])
        raw = np.frombuffer(b"".join(b + bytes(8) for b, _, _ in blocks), np.uint8).astype(np.uint64)
        window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
        at = np.concatenate([c.astype(np.int64) + 8 * int(room[i]) for i, (_, c, _) in enumerate(blocks)])
        left = np.concatenate([n for _, _, n in blocks]).astype(np.int64)
        out, live = np.zeros((len(at), STRIDE), np.uint32), len(at)
        by = np.argsort(-left, kind="stable")
        at, todo = at[by], left[by]
        shift, mask = np.uint64(40 - self.width), np.uint64((1 << self.width) - 1)
        for k in range(int(todo[0]) if len(todo) else 0):
            live = int(np.searchsorted(-todo[:live], -k, side="left"))
            now = at[:live]
            key = ((window[now >> 3] >> (shift - (now & 7).astype(np.uint64))) & mask).astype(np.int64)
            out[:live, k] = self.symbol[key]
            at[:live] += self.step[key]
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        out, found, row = out[back], [], 0
        for _, c, n in blocks:
            rows = out[row : row + len(c)]
            found.append(rows[np.arange(STRIDE) < n[:, None]])
            row += len(c)
        return found


# Files ----------------------------------------------------------------------------------------


def _block(ids: list[int | None], counts: list[int], bits: list[bytes], marks: list[bytes]) -> bytes:
    """A block of documents; checkpoints become bit offsets in the block."""
    size = np.array([len(b) for b in bits], np.int64)
    strides = np.array([len(m) // 4 for m in marks], np.int64)
    at = np.frombuffer(b"".join(marks), "<u4") + np.repeat(8 * (np.cumsum(size) - size), strides)
    payload = b"".join(bits)
    head = struct.pack("<5I", len(ids), sum(counts), STRIDE, len(payload), zlib.crc32(payload))
    keys = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    flags = np.array([i is None for i in ids], np.uint8).tobytes()
    return head + keys + flags + np.array(counts, "<u4").tobytes() + at.astype("<u4").tobytes() + payload


def _parse(raw: bytes):
    docs, _, stride, size, crc = struct.unpack_from("<5I", raw)
    at = 20
    ids = np.frombuffer(raw, "<i8", docs, at)
    flags = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(raw, "<u4", docs, at := at + docs).astype(np.int64)
    strides = -(-counts // STRIDE)
    marks = np.frombuffer(raw, "<u4", int(strides.sum()), at := at + 4 * docs)
    payload = raw[at + 4 * len(marks) :]
    if len(payload) != size or zlib.crc32(payload) != crc or stride != STRIDE:
        raise ValueError("damaged block")
    ends = np.cumsum(strides)
    rank = np.arange(len(marks)) - np.repeat(ends - strides, strides)
    todo = np.minimum(np.repeat(counts, strides) - STRIDE * rank, STRIDE)
    return ids, flags, counts, (payload, marks, todo)


def _lengths(f) -> np.ndarray:
    f.seek(0)
    head = f.read(len(MAGIC) + 12)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    _, n, size = struct.unpack("<3I", head[len(MAGIC) :])
    return np.frombuffer(zlib.decompress(f.read(size)), np.uint8, n)


ENCODED = "k long, width int, ids binary, counts binary"
MANIFEST = "file string, part int, block int, offset long, size long, documents long, tokens long, before long"


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool, text: str, key: str) -> DataFrame:
    """(k, ids) per row: ids of the whole text and the end id, as u16 or, for larger vocabularies, u32.

    The last row of a task has no ids but ``counts``, how often each id occurred in the task (i64 by id).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, by_word)
        kind = "<u2" if max(encoder.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        total, names = np.zeros(0, np.int64), ["k", "width", "ids", "counts"]
        for batch in batches:
            for a, texts in texts_of(batch.column(1), 8 << 20):
                flat, n = _with_end(*encoder(texts), end_id)
                more = np.bincount(flat, minlength=len(total))
                more[: len(total)] += total
                ends, flat, total = np.cumsum(n), flat.astype(kind), more
                rows = [flat[e - c : e].tobytes() for e, c in zip(ends, n)]
                wide = pa.array(np.full(len(rows), int(kind[-1]), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), wide, blobs(rows), pa.nulls(len(rows), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), blobs([total.astype("<i8").tobytes()])], names
            )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), bytes_of(F.col(f"`{text}`")).alias("t"))
    return rows.mapInArrow(encode, ENCODED)


def _ids(batch: pa.RecordBatch, width: int, ids: int, most: int = 1 << 20):
    """(first row, ids in a row, ids per row) of runs of rows."""
    kinds = batch.column(width).to_numpy(zero_copy_only=False)
    for a, rows in texts_of(batch.column(ids), most):
        kind = f"<u{kinds[a]}"
        yield a, np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // int(kinds[a])


def count_ids(encoded: DataFrame) -> np.ndarray:
    """Global counts of ids from the counts of the tasks; the driver gets one row per id of the vocabulary."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = np.frombuffer(raw, "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = encoded.filter("counts IS NOT NULL").select("counts").mapInArrow(counts, "id long, n long")
    rows = rows.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    total[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


def write_corpus(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, by_word: bool = True, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Encode all texts and write them in ascending key order below ``folder``; gives the manifest.

    Texts are encoded once into a work table, and their ids counted on the way; only coded bits
    are shuffled, by ranges of the key. A task writes under a name of its own, and only files of tasks
    that succeeded are in the manifest. Null texts are empty, null keys come first, rows of equal keys
    follow each other in order of their bits.
    """
    spark = docs.sparkSession
    encode_texts(docs, tokenizer, end_id, by_word, text, key).write.option("compression", "zstd").parquet(f"{folder}/ids")
    encoded = spark.read.schema(ENCODED).parquet(f"{folder}/ids")
    lengths = code_lengths(count_ids(encoded))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for a, flat, n in _ids(batch, 1, 2):
                bits, marks = codec.encode(flat, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), pa.array(n, pa.int64()), blobs(bits), blobs(marks)], ["k", "n", "bits", "marks"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, path = files.FileSystem.from_uri(folder)
        name, rows, out = f"ids-{part:06d}-{uuid.uuid4().hex}.tok", [], None
        ids, counts, bits, marks, room, at, before = [], [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, counts, bits, marks, room, at, before
            raw = _block(ids, counts, bits, marks)
            out.write(raw)
            rows.append((name, part, len(rows), at, len(raw), len(ids), room, before))
            at, before = at + len(raw), before + room
            ids, counts, bits, marks, room = [], [], [], [], 0

        for batch in batches:
            for k, n, b, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}")
                    packed = zlib.compress(lengths.tobytes())
                    head = MAGIC + struct.pack("<3I", end_id, len(lengths), len(packed)) + packed
                    out.write(head)
                    at = len(head)
                ids.append(k), counts.append(n), bits.append(b), marks.append(m)
                room += n
                if room >= BLOCK_TOKENS:
                    flush()
        if ids:
            flush()
        if out is not None:
            out.close()
        if rows:
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            columns = [x.split(" ") for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows), columns)], [c for c, _ in columns])

    coded = encoded.filter("counts IS NULL").select("k", "width", "ids").mapInArrow(code, "k long, n long, bits binary, marks binary")
    ordered = coded.repartitionByRange("k").sortWithinPartitions("k", "n", "bits")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    discard(spark, folder, "ids")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_corpus(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): one row per document of a corpus folder; ids are little-endian u32.

    ``start`` counts the ids of all documents before it. Blocks are dealt to tasks; what the driver
    adds up is one number per file.
    """
    blocks = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    total = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    base = np.cumsum([0, *[r["n"] for r in total]])
    bases = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(total, base)], "part int, base long")
    todo = blocks.join(bases, "part").withColumn("before", F.col("before") + F.col("base"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, path = files.FileSystem.from_uri(folder)
        handle, opened, codec, last = None, None, None, None
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                group, room = [], 0
                while rows and room < 8 * BLOCK_TOKENS and (not group or rows[0]["file"] == group[0][0]["file"]):
                    r = rows.pop(0)
                    if r["file"] != opened:
                        handle, opened = store.open_input_file(f"{path}/{r['file']}"), r["file"]
                        lengths = _lengths(handle)
                        if last is None or not np.array_equal(last, lengths):
                            codec, last = Codec(lengths), lengths
                    handle.seek(r["offset"])
                    group.append((r, _parse(handle.read(r["size"]))))
                    room += r["tokens"]
                flats = codec.decode([p[3] for _, p in group])
                for (r, (ids, flags, counts, _)), flat in zip(group, flats):
                    ends = np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64(), mask=flags.astype(bool)),
                            pa.array(r["before"] + ends - counts, pa.int64()),
                            pa.array(counts, pa.int64()),
                            blobs([flat[e - c : e].astype("<u4").tobytes() for e, c in zip(ends, counts)]),
                        ],
                        [key, "start", "n_tokens", "ids"],
                    )

    dealt = todo.select("file", "block", "offset", "size", "tokens", "before").repartition(n, "file", "block")
    return dealt.sortWithinPartitions("file", "block").mapInArrow(read, f"{key} long, start long, n_tokens long, ids binary")
