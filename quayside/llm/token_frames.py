"""Token ids as files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of their keys, a frame each (ids as little-endian unsigned 32-bit integers, the end
id last), then one frame with the keys (an Arrow stream), then the seek table in zstandard's seekable format: a skippable frame
with the compressed size, the size and the checksum (low 32 bits of XXH64) of each frame, and a footer. Any zstandard reader can
decompress the file; this one reads the table and then only the frames it is asked for, and checks each.

Files are ranges of the keys (within a key, of the texts' hashes): the text is shuffled once, by range, and each task writes one file, under a name of its own
attempt. The manifest, itself a table in shared storage, lists the files of the attempts that succeeded; so a lost executor or
a repeated task leaves at most an unlisted file. Positions over all files come from the manifest's sums.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import BinaryIO, NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import cut, fresh_dir, slices, text_or_empty

END_ID = 1
TABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Distinct words whose ids a task remembers; it begins anew beyond.
REMEMBERED = 600_000


class Frame(NamedTuple):
    at: int
    packed: int
    size: int
    checksum: int


class Writer:
    def __init__(self, out: BinaryIO, level: int = 3) -> None:
        self.out, self.zstd, self.frames = out, zstandard.ZstdCompressor(level=level), []

    def add(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        body = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, FOOTER)
        self.out.write(struct.pack("<II", TABLE, len(body)) + body)


class Reader:
    """Over any file that can seek; reads the footer and the table, and then the frames that are asked for."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table")
        file.seek(size - 9 - 12 * n - 8)
        if struct.unpack("<II", file.read(8)) != (TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        rows = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(rows[:, 0])])
        self.frames = [Frame(int(a), int(p), int(s), int(c)) for a, (p, s, c) in zip(starts, rows)]
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        x = self.frames[i]
        self.file.seek(x.at)
        data = self.zstd.decompress(self.file.read(x.packed), max_output_size=max(1, x.size))
        if len(data) != x.size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != x.checksum:
            raise ValueError(f"frame {i} is damaged")
        return data

    def keys(self) -> pa.Array:
        table = pa.ipc.open_stream(self.frame(len(self.frames) - 1)).read_all()
        return table.column(0)

    def __len__(self) -> int:
        return len(self.frames) - 1

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i), "<u4")


class Encoder:
    """Ids of whole texts by the tokenizers library.

    For tokenizers like that of word_bpe_49k.json alone (lower case, words ended by "</w>", byte-level letters): another must not
    be given. The tokenizer drops white space and joins nothing across it, so each distinct word is encoded once. A plain word (Latin
    letters below U+0250, no apostrophe, no special token) is cut into its runs of letters, digits and other signs as the
    tokenizer's own rule does, and each distinct run meets the vocabulary once; all other words go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.runs.normalizer, self.runs.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ascii_runs = re.compile("[a-z]+|[0-9]|\n|[^a-z0-9\n]+").findall
        self.latin_runs = regex.compile(r"\p{L}+|\p{N}|\n|[^\s\p{L}\p{N}]+").findall
        # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.forget()

    def forget(self) -> None:
        # the empty word stands before and after white space at a text's ends
        self.words, self.runs_at = {b"": 0}, {"\n": 0}
        self.word_ids, self.word_ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.run_ids, self.run_ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Puts new words, in this order, behind those that are known."""
        texts = b"\n".join(words).decode().split("\n")
        kinds: dict[str, list[int]] = {"ascii": [], "latin": [], "other": []}
        for i, t in enumerate(texts):
            if t.isascii():
                kinds["ascii" if t.isprintable() and "'" not in t and "<|" not in t else "other"].append(i)
            else:
                kinds["latin" if max(t) < "\u0250" and "'" not in t and "<|" not in t and "\u0130" not in t else "other"].append(i)
        ids, sizes = [], np.zeros(len(words), np.int64)
        for kind, at in kinds.items():
            if kind == "other":
                own = [np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in at]
                size, flat = [len(x) for x in own], np.concatenate(own) if own else np.zeros(0, np.uint32)
            elif at:
                runs = (self.ascii_runs if kind == "ascii" else self.latin_runs)("\n".join([texts[i] for i in at]).lower())
                if kind == "latin":
                    runs = [r if r.isascii() else r.encode().decode("latin-1").translate(self.letters) for r in runs]
                row = self.learn_runs(runs)
                n = self.run_ends[row + 1] - self.run_ends[row]
                word = np.cumsum(row == 0)
                size, flat = np.bincount(word, n, minlength=len(at)).astype(np.int64), gathered(self.run_ids, self.run_ends, row)
            else:
                continue
            sizes[at] = size
            ids.append((at, flat))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        fresh = np.zeros(ends[-1], np.uint32)
        for at, flat in ids:
            start, size = ends[:-1][at], sizes[at]
            fresh[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
        self.word_ids = np.concatenate([self.word_ids, fresh])
        self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + ends[1:]])

    def learn_runs(self, runs: list[str]) -> np.ndarray:
        """The number of each run; newlines have 0 and no ids."""
        fresh = list(set(runs).difference(self.runs_at))
        parts, sizes = [], []
        for i in range(0, len(fresh), 256):
            part = fresh[i : i + 256]
            ids = np.array(self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary doesn't mark where words end")
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        if fresh:
            self.runs_at.update(zip(fresh, range(len(self.runs_at), len(self.runs_at) + len(fresh))))
            self.run_ids = np.concatenate([self.run_ids, *parts])
            self.run_ends = np.concatenate([self.run_ends, self.run_ends[-1] + np.cumsum(np.concatenate(sizes))])
        return np.fromiter(map(self.runs_at.__getitem__, runs), np.int64, len(runs))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > REMEMBERED:
            self.forget()
        # Arrow cuts the words and numbers the distinct ones; only these meet a Python table
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        counted = lists.flatten().dictionary_encode()
        distinct = counted.dictionary.view(pa.large_binary()).to_pylist()
        if fresh := [w for w in distinct if w not in self.words]:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
            self.learn(fresh)
        rows = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[counted.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return [gathered(self.word_ids, self.word_ends, rows[i:j]) for i, j in zip(ends[:-1], ends[1:])]


def gathered(ids: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """ids[ends[r]:ends[r + 1]] of each r, one after the other."""
    start, size = ends[row], ends[row + 1] - ends[row]
    return ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all rows of docs and gives the manifest: file, part, n_docs, n_tokens, first_token.

    Null texts are as empty ones: the end id alone. Rows that repeat a key are all written, in the order of their texts' hashes
    (so they may lie in several files); null keys come first. An empty table gives no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder, tokenizer = folder or fresh_dir(spark, "tokens"), tokenizer or tokenizer_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, keys, total, writer = TaskContext.get(), [], 0, None
        for b in slices(batches, "t"):
            if writer is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{context.partitionId():05d}-{uuid4().hex}.tok.zst"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(out)
            keys.append(b.column("k"))
            for ids in encoder(tokenizer).encode(b.column("t").cast(pa.binary()).to_pylist()):
                writer.add(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                total += len(ids) + 1
        if writer is not None:
            sink = pa.BufferOutputStream()
            table = pa.table({"key": pa.chunked_array(keys)})
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            writer.add(sink.getvalue().to_pybytes())
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([context.partitionId()], pa.int32()), pa.array([table.num_rows], pa.int64()), pa.array([total], pa.int64())], ["file", "part", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    manifest = cut(rows.mapInArrow(task, "file string, part int, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return manifest.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "part", "n_docs", "n_tokens", F.coalesce(before, F.lit(0)).alias("first_token"))


def read_digest(manifest: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """A row for each document, from the files: key, start, n_tokens, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column("file").to_pylist(), b.column("first_token").to_pylist()):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    reader = Reader(f, f.size())
                    keys = reader.keys()
                    for lo in range(0, len(reader), 4096):
                        starts, sizes, sums = [], [], []
                        for i in range(lo, min(lo + 4096, len(reader))):
                            data = reader.frame(i)
                            starts.append(at)
                            sizes.append(len(data) // 4)
                            sums.append(zlib.crc32(data))
                            at += len(data) // 4
                        own = keys.slice(lo, len(starts))
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(own.chunks), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], [key, "start", "n_tokens", "ids_crc32"])

    files = manifest.count()  # a task each: by size alone, Spark would give the short rows of a manifest to one task
    return manifest.repartition(max(1, files)).mapInArrow(task, f"`{key}` {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")
