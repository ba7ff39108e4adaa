"""Token ids in ORC files.

Documents are dealt to partitions by ranges of ``doc_id`` (and, within an id, of
a hash of the text, so that an id of many rows is no single task), sorted, encoded,
and written as ORC: ids are an integer column in run-length encoding, stripes
hold row indexes, and ``doc_id`` carries a Bloom filter. Each file numbers its
ids from 0; where a file begins among all ids follows from the sums of the files
before it, read from the narrow columns alone. Stripes are read in parallel, and
a filter on ``doc_id`` skips stripes and row groups by their metadata.

A tokenizer whose normaliser and splitter never join text over white space, and
part letters from signs, is recognised by its own description (``WORDWISE``).
Texts are then cut at white space and encoded by distinct word, all in columns:
the distinct pieces of a batch fall into letters and the signs behind them, and
a worker keeps the ids of words. Any other tokenizer encodes whole texts.

Defined results: a null text is empty and has the end id only; rows that repeat
an id are written each, ordered by id and a hash of the text; null ids come first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.workspace import bound_batches, hinted, materialise, scratch, table

#: Words, and pieces that are not words, whose ids a worker keeps in each of two generations.
WORD_CACHE, PIECE_CACHE = 500_000, 50_000
#: Bytes of text that are encoded together, about.
TEXT_BYTES = 4 << 20
#: Signs that the splitter parts from letters before them, and keeps together.
MARKS = ".,!?;:%$*&#|"
#: The normaliser and the splitter of the tokenizers that may be encoded word by word.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
ORC = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20), "orc.dictionary.key.threshold": "0", "compression": "snappy",
}
_encoders: dict = {}


class _Kept:
    """Values by key in two generations: a full young one becomes the old one, so what is in use stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get_all(self, keys: list[bytes], learn) -> list:
        """Values of distinct ``keys``; ``learn`` gives those of keys that are not held."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        lacking = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in lacking:
            x = out[i] = self.old.get(keys[i])
            if x is None:
                new.append(i)
            else:
                self.young[keys[i]] = x
        if new:
            for i, x in zip(new, learn([keys[i] for i in new]), strict=True):
                out[i] = self.young[keys[i]] = x
        return out


#: Stands for the ids of a word that has to be encoded together with the signs behind it.
UNSAFE = b"\0"


def _gathered(flat: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, of ``sizes`` each, in the order of ``pick``; and the size of each."""
    n, starts = sizes[pick], np.cumsum(sizes) - sizes
    at = np.repeat(starts[pick] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at], n


class _Encoder:
    """A tokenizer that encodes batches of texts, word by word if its description allows.

    A piece between white space whose letters are followed by some ``MARKS`` only
    falls into these two, as the splitter parts them. That holds for letters that are
    letters for the splitter, and nothing else, after normalising: each character
    beyond ASCII is tried. New words are encoded as one text: a word is one token of
    the splitter, and its last id is one that ends a word. If the ends don't number as
    many as the words, and for all other pieces, each is encoded alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        suffix = told["model"].get("end_of_word_suffix")
        self.wordwise = all(told[k] == v for k, v in WORDWISE.items()) and bool(suffix) and not any(a["lstrip"] or a["rstrip"] or set(a["content"]) & set(" \t\n\v\f\r") for a in told["added_tokens"])
        self.words, self.pieces, self.marks, self.plain_letters = _Kept(WORD_CACHE), _Kept(PIECE_CACHE), _Kept(PIECE_CACHE), {}
        if self.wordwise:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _alone(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _letter(self, c: str) -> bool:
        """Whether the splitter takes a character, normalised, for letters that it parts from a sign."""
        known = self.plain_letters.get(c)
        if known is None:
            normal = self.tokenizer.normalizer.normalize_str(c)
            known = self.plain_letters[c] = c.isalpha() and normal.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(normal + ",")) == 2
        return known

    def _learn_words(self, words: list[bytes]) -> list[bytes]:
        safe = [w.isalpha() or all(map(self._letter, w.decode("utf-8", "replace"))) for w in words]
        out = [UNSAFE] * len(words)
        good = [i for i, s in enumerate(safe) if s]
        for k in range(0, len(good), 4096):
            some = [words[i] for i in good[k : k + 4096]]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some) and at[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * at).tolist()
                own = [raw[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905  the first list is longer by one
            else:
                own = self._alone(some)
            for i, x in zip(good[k : k + 4096], own, strict=True):
                out[i] = x
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.wordwise:
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], add_special_tokens=False)]
            return np.concatenate([*ids, np.empty(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, sizes = self._encode_pieces(coded.dictionary)
        ids, n = _gathered(flat, sizes, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(n)])
        offsets = lists.offsets.to_numpy()
        return ids, np.diff(upto[offsets - offsets[0]])

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and how many each has."""
        bare = pc.ascii_rtrim(pieces, characters=MARKS)
        in_ascii = pc.string_is_ascii(bare).to_numpy(zero_copy_only=False)
        letters = pc.ascii_is_alpha(bare).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare).filter(pa.array(letters | ~in_ascii)).dictionary_encode()
        word = np.full(len(pieces), -1, np.int64)
        word[letters | ~in_ascii] = coded.indices.to_numpy()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        found = self.words.get_all(names, self._learn_words)
        unsafe = np.array([x is UNSAFE for x in found], bool)
        if unsafe.any():
            word[(word >= 0) & unsafe[word]] = -1
            found = [b"" if x is UNSAFE else x for x in found]
        whole = np.flatnonzero(word < 0)  # encoded with all their signs
        word[whole] = len(found) + np.arange(len(whole))
        found += self.pieces.get_all(pieces.take(pa.array(whole)).cast(pa.binary()).to_pylist(), self._alone)
        extra = pc.binary_length(pieces).to_numpy() - pc.binary_length(bare).to_numpy()
        extra[whole] = 0
        marked = np.flatnonzero(extra)
        none = len(found)
        mark = np.full(len(pieces), none, np.int64)
        ends = [p[-n:] for p, n in zip(pieces.take(pa.array(marked)).cast(pa.binary()).to_pylist(), extra[marked].tolist(), strict=True)]
        kinds = {m: none + 1 + i for i, m in enumerate(dict.fromkeys(ends))}
        mark[marked] = [kinds[m] for m in ends]
        found += [b"", *self.marks.get_all(list(kinds), self._alone)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, n = _gathered(np.frombuffer(b"".join(found), "<u4"), sizes, np.stack([word, mark], 1).ravel())
        return ids, n.reshape(-1, 2).sum(1)


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def plain(column) -> pa.Array:
    """One array; a batch that Spark cut by bytes has chunks."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write ``doc_id, local_start, n_tokens, ids`` of all ``docs`` in ascending ``doc_id`` order."""
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = encoder(tokenizer), 0
        for whole in batches:
            for b in portions(whole):
                ids, n = own.encode(plain(b.column("text")))
                upto = np.cumsum(n)
                ids = np.insert(ids, upto, end_id)  # one behind each text
                offsets = np.concatenate([[0], upto + np.arange(1, len(n) + 1)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([plain(b.column("doc_id")).cast(pa.int64()), pa.array(at + offsets[:-1]), pa.array(n + 1), lists], ["doc_id", "local_start", "n_tokens", "ids"])
                at += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism * 2, rows.rdd.getNumPartitions())  # as many as splits of the scan
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    dealt.mapInArrow(encode, "doc_id long, local_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``TEXT_BYTES`` of text, about; a longer text is one by itself."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(plain(batch.column("text"))), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(upto // TEXT_BYTES)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the files below ``path``; start counts the ids of all documents before."""
    rows = spark.read.schema("doc_id long, local_start long, n_tokens long, ids array<int>").orc(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("known"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), F.char_length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = materialise(files.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "file_starts")
    return rows.join(hinted(starts, 192), F.col("file") == F.col("f")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``ids``."""
    bound_batches(tokens.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = plain(b.column("ids"))
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(plain(b.column(c)) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_orc(spark, sf_dir, tokenizer: str | None = None):
    """Encode all documents, write the ORC files and digest what is read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer, 2)
    return with_crc32(read_tokens(spark, path))
