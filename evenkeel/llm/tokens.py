"""Token ids of documents in files of their own format, in order of the documents' ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import running_total
from evenkeel.llm.pfor import TokenFile, encode_file, read_tokens
from evenkeel.session import cut_lineage

END = 1
FILE_TOKENS = 4_000_000
CACHED_PIECES = 400_000
MARKS = (",", ".")
JOINED = 256
LONGEST_CACHED = 64
#: Texts are encoded together up to so many characters; a longer one by itself.
ENCODED_TOGETHER = 2_000_000
# What a vocabulary does to texts before it joins letters, for which pieces
# between spaces are independent and letters are lower-cased.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
WORDS = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}


def independent(spec: dict) -> bool:
    """Whether the vocabulary's own description says that texts are lower-cased, white space is
    only a gap and no token reaches over one."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        tuple(s["type"] for s in steps) == NORMALIZERS and steps[1] == SPACES
        and splits[:1] == [WORDS] and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in splits[1:])
        and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )


def stem(piece: str) -> tuple[str, str]:
    """(word, mark): a comma or stop at the end after a letter is a word of its own to the
    vocabulary, and letters are lower-cased by it."""
    mark = piece[-1] if piece[-1:] in MARKS and piece[-2:-1].isalpha() else ""
    word = piece[:-1] if mark else piece
    return (word.lower() if word.isascii() else word), mark


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A vocabulary that is :func:`independent` never joins over a space or line end, so a text's
    ids are those of its pieces between them one after another. The pieces of many texts are
    made, numbered and put together as whole columns; a distinct one is encoded once as long as
    it is in one of two generations of known pieces; a full one replaces the older one, from
    which pieces met again move over. Any other vocabulary encodes whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = independent(json.loads(self.tokenizer.to_str()))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {"": b"", **dict(zip(MARKS, self._encode(list(MARKS))))}

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of each piece. Pieces are joined by spaces for speed; where a token starts tells
        whose it is."""
        parts = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        found = self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found):
            ends = np.cumsum([len(p) + 1 for p in part])
            begins = np.array([o[0] for o in e.offsets], dtype=np.int64)
            cuts = (4 * np.searchsorted(begins, ends, side="left")).tolist()
            data, at = np.array(e.ids, dtype="<u4").tobytes(), 0
            for cut in cuts:
                yield data[at:cut]
                at = cut

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.cache.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        cache, older = self.cache, self.older
        stems: list[tuple[int, str, str]] = []
        roots: dict[str, bytes | None] = {}
        for i in new:
            p = pieces[i]
            ids = found[i] = older.get(p)
            if ids is None:
                root, mark = stem(p)
                stems.append((i, root, mark))
                roots[root] = None
            else:
                cache[p] = ids
        unknown = []
        for root in roots:
            ids = roots[root] = cache.get(root) or older.get(root)
            if ids is None:
                unknown.append(root)
        roots.update(zip(unknown, self._encode(unknown)))
        for i, root, mark in stems:
            found[i] = roots[root] + self.marks[mark]
            if len(pieces[i]) <= LONGEST_CACHED:
                cache[pieces[i]] = found[i]
                cache[root] = roots[root]
        if len(cache) > CACHED_PIECES:
            self.cache, self.older = {}, cache
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_pieces:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        split = pc.split_pattern(lines, " ")
        coded = pc.dictionary_encode(split.flatten())
        pieces = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy().tolist()
        cuts = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
        return [b"".join(map(pieces.__getitem__, codes[a:b])) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept for its next tasks."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def open_store(uri: str):
    """(file system, path) of a shared folder, which executors write to and read directly."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    end: int = END, parts: int | None = None, file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write token files to ``folder`` and return their list (part, file, name, n_docs, n_tokens).

    Documents are dealt by ranges of their id and sorted within: files in the order of (part,
    file) hold them in ascending order, rows without an id first. Each document's ids are
    followed by ``end``. A file has whole documents and about ``file_tokens`` ids. It is
    written under the attempt's own name and then renamed, so a task that runs again leaves
    the same files. A null text is empty. Repeated rows are written each. An empty table gives
    no file. Other columns are not read. ``folder`` must be one that all executors share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    stop = np.array([end], dtype="<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, encode = TaskContext.get(), encoder(vocabulary)
        store, root = open_store(folder)
        part, made = context.partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []

        def close() -> pd.DataFrame:
            nonlocal made
            joined = np.frombuffer(b"".join(ids), dtype="<u4")
            name = f"tokens-{part:06d}-{made:06d}.pfor"
            own = f"{root}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(encode_file(joined, doc_ids, counts))
            store.move(own, f"{root}/{name}")
            row = pd.DataFrame({"part": [part], "file": [made], "name": [name], "n_docs": [len(doc_ids)], "n_tokens": [len(joined)]})
            made += 1
            for x in (ids, doc_ids, counts):
                x.clear()
            return row

        size = 0
        for batch in batches:
            total = batch["text"].str.len().cumsum()
            for _, some in batch.groupby(total.sub(1).clip(lower=0) // ENCODED_TOGETHER, sort=True):
                for i, found in zip(some["id"], encode(some["text"].tolist())):
                    ids += [found, stop]
                    doc_ids.append(None if pd.isna(i) else int(i))
                    counts.append(len(found) // 4 + 1)
                    size += counts[-1]
                    if size >= file_tokens:
                        yield close()
                        size = 0
        if doc_ids:
            yield close()

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    return cut_lineage(
        ordered.mapInPandas(write, "part int, file int, name string, n_docs bigint, n_tokens bigint"), "token-files"
    )


def read_documents(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document of the listed files, in their order, with
    the ids decoded from the files; start counts the ids of all documents before."""
    before = running_total(files, "n_tokens", ["part", "file"], "before")
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = before.select("name", "before").repartition(parts, "name")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for batch in batches:
            for name, start in zip(batch["name"], batch["before"]):
                with store.open_input_file(f"{root}/{name}") as f:
                    data = np.frombuffer(f.read(), dtype=np.uint8)
                file = TokenFile.read(data)
                ids = read_tokens(data, file, 0, file.n_tokens).astype("<u4")
                ends = np.cumsum(file.counts)
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(file.counts, ends)]
                known = pd.array(file.doc_ids, dtype="Int64")
                known[~file.has_id] = pd.NA
                yield pd.DataFrame({"id": known, "start": int(start) + ends - file.counts, "n_tokens": file.counts, "ids_crc32": np.array(crc, dtype=np.int64)})

    found = dealt.mapInPandas(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", id_col)
