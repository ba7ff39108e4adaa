"""Encoding and decoding with merge-type SentencePiece models, without walking through merges.

A sequence of pieces is the one that merging arrives at if and only if each two
neighbours are: merged again by themselves, the two texts give the two pieces back.
So a text is covered from the left with longest matches, found for all places in one
Aho-Corasick pass. A piece is taken if it is compatible with the piece before; if not,
the next shorter piece that begins there is tried; if none is left, the last piece is
given up, and its end is marked in a bitfield as a place from which no way leads on.
Every place is marked at most once, so the work is linear in the text.

Compatibility of two pieces undoes their merges from the last on: as long as no merge
over their border would have come first, they stay apart (``Pieces.apart``).

No merge goes over a place whose two neighbouring characters stand side by side in no
piece, so the text is cut there; the distinct parts of a batch are encoded once and a worker
keeps their ids. A character that is no piece falls into its bytes and parts what is around it.

Defined results: a null text is empty, an empty text has its begin and end ids only, and
rows that repeat are encoded each. ``decode`` takes any ids of the model: control ids
say nothing, bytes that form no character become U+FFFD each, a null list has a null text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokenfiles import _gathered, _Kept, plain, portions
from lodestone.llm.workspace import bound_batches, table

SPACE = "▁"
#: Parts of texts whose ids a worker keeps in each of two generations, and checked pairs of pieces.
PART_CACHE, PAIR_CACHE = 200_000, 500_000
_models: dict = {}


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a message in the protocol buffers' wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at : at + n]
            at += n


def normaliser(model: bytes) -> dict:
    """Whether the model's texts get a space before them, lose extra spaces, or are changed by rules."""
    spec = dict(_fields(dict(_fields(model)).get(3, b"")))
    return {"prefix": bool(spec.get(3, 1)), "trim": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1)), "rules": bool(spec.get(2, b""))}


class Surface:
    """What the ids of a model say."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            told = f.read()
        trainer, spec = dict(_fields(dict(_fields(told)).get(2, b""))), normaliser(told)
        size = own.get_piece_size()
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if trainer.get(3, 1) != 2 or spec["trim"] or spec["rules"] or not spec["escape"] or any(own.is_unused(i) for i in range(size)) or not all(map(own.is_byte, self.bytes)):
            raise ValueError("not a merge-type model with bytes for unknown characters and plain texts")
        self.prefix, self.begin, self.end, unknown = spec["prefix"], own.bos_id(), own.eos_id(), own.unk_id()
        self.control = np.array([own.is_control(i) for i in range(size)])
        self.is_byte = np.array([own.is_byte(i) for i in range(size)])
        self.text = {i: own.id_to_piece(i).replace(SPACE, " ") for i in range(size) if not (self.control[i] or self.is_byte[i] or i == unknown)}
        self.scores = [own.get_score(i) for i in range(size)]
        byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        surface = [byte.get(i) or (self.text[i].encode() if i in self.text else b"" if self.control[i] else " ⁇ ".encode()) for i in range(size)]
        self.surface, self.surface_sizes = np.frombuffer(b"".join(surface), np.uint8), np.array([len(x) for x in surface], np.int64)
        self.spaced = np.array([x.startswith(b" ") and i in self.text for i, x in enumerate(surface)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of lists of ids that stand one after another."""
        ids, sizes = ids.astype(np.int64), sizes.astype(np.int64)
        raw, n = _gathered(self.surface, self.surface_sizes, ids)
        upto, at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(sizes)])
        said = np.flatnonzero(~self.control[ids])
        first = np.searchsorted(said, at[:-1])  # of each list, the first id that says something
        has = first < len(said)
        place = np.where(has, said[np.minimum(first, max(0, len(said) - 1))] if len(said) else 0, 0)
        drop = has & (place < at[1:]) & (self.spaced[ids[place]] if len(ids) else False) & self.prefix
        of_bytes = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        mixed = of_bytes[at[1:]] > of_bytes[at[:-1]]
        whole, out = raw.tobytes(), []
        for k, (i, j) in enumerate(zip(upto[at[:-1]].tolist(), upto[at[1:]].tolist(), strict=True)):
            text = whole[i:j]
            if mixed[k]:
                own = ids[at[k] : at[k + 1]]
                broken = bool(self.control[own[1:-1]].any())  # a control id parts bytes
                try:
                    text.decode()
                except UnicodeDecodeError:
                    broken = True
                text = self._mended(own) if broken else text
            out.append(text[1:] if drop[k] else text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """The text of ids whose runs of bytes hold wrong ones."""
        out, run = [], bytearray()

        def close() -> None:
            k = 0
            while k < len(run):
                n = 1 if run[k] < 0x80 else 2 if run[k] >> 5 == 6 else 3 if run[k] >> 4 == 14 else 4 if run[k] >> 3 == 30 else 0
                good = bytes(run[k : k + n])
                try:
                    good.decode()
                except UnicodeDecodeError:
                    n = 0
                if n and len(good) == n:
                    out.append(good)
                else:
                    out.append("�".encode())
                    n = 1
                k += n
            run.clear()

        upto = np.cumsum(self.surface_sizes) - self.surface_sizes
        for i in ids.tolist():
            piece = self.surface[upto[i] : upto[i] + self.surface_sizes[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                close()
                out.append(piece)
        close()
        return b"".join(out)


class Pieces(Surface):
    """The pieces of a model, the merge that makes each, and which of them may be neighbours.

    A rank orders merges as the model's scores do; of equal ones the left comes first.
    A piece that merging its own text doesn't give never occurs, so it has no match.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.ids = {t: i for i, t in self.text.items()}
        if any(c not in self.ids for t in self.ids for c in t):
            raise ValueError("a piece has a character that is no piece")
        order = {s: n for n, s in enumerate(sorted({self.scores[i] for i in self.text}, reverse=True))}
        self.rank = {i: order[self.scores[i]] for i in self.text}
        # pairs of neighbouring bytes at which a text may be cut: those in no piece, and not inside a character
        self.cut = np.ones((256, 256), bool)
        for t in self.ids:
            raw = np.frombuffer(t.encode(), np.uint8)
            self.cut[raw[:-1], raw[1:]] = False
        self.cut[:, 0x80:0xC0] = False
        self.split = {}
        for t, i in sorted(self.ids.items(), key=lambda x: (self.rank[x[1]], len(x[0]))):
            parts, last = self._merged(t)
            if len(parts) == 1 and len(t) > 1:
                self.split[i] = last
                if max(self._made(last[0]), self._made(last[1])) > self.rank[i]:
                    raise ValueError("a merge comes before the merges of its parts")
        size = len(self.scores)
        self.characters = {t for t in self.ids if len(t) == 1}
        self.known, self.pairs = _Kept(PART_CACHE), {}
        self.whole = {t: i for t, i in self.ids.items() if len(t) == 1 or i in self.split}
        self.sizes = [len(self.text.get(i, "")) for i in range(size)]
        self.shorter = [-1] * size  # the longest piece that a piece begins with
        self.matches = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.shorter[i] = next((self.whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.whole), -1)
            self.matches.add_word(t, i)
        self.matches.make_automaton()

    def _made(self, piece: int) -> int:
        """When a piece is made; a single character is there from the beginning."""
        return self.rank[piece] if piece in self.split else -1

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pieces of a short text by merging, and the last merge."""
        parts, last = [self.ids[c] for c in text], None
        while True:
            best = None
            for k in range(len(parts) - 1):
                both = self.ids.get(self.text[parts[k]] + self.text[parts[k + 1]])
                if both is not None and (best is None or self.rank[both] < best[0]):
                    best = (self.rank[both], k, both)
            if best is None:
                return parts, last
            _, k, both = best
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [both]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the texts of two pieces gives the two pieces."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # ``before``: a merge over the border of a smaller rank would have come first
        before = float("inf")
        while True:
            over = self.ids.get(self.text[left] + self.text[right])
            if over is not None and self.rank[over] < before:
                return False
            a, b = self._made(left), self._made(right)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left piece was made last; at its rank its own merge stands left of the border
                before, left = a, self.split[left][1]
            else:  # at the rank of the right piece's merge the border stands left of it
                before, right = b + 1, self.split[right][0]

    def cover(self, text: str) -> list[int]:
        """The pieces of a text whose characters are all pieces."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        n, sizes, shorter, pairs = len(text), self.sizes, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for stop, piece in self.matches.iter(text):  # by ascending end, so the longest of a place comes last
            longest[stop + 1 - sizes[piece]] = piece
        failed, any_failed = bytearray((n >> 3) + 1), False  # a bit for each place that no way leads on from
        out, at, last, piece = [], 0, -1, longest[0]
        while at < n:
            while piece >= 0:
                stop = at + sizes[piece]
                if not (any_failed and failed[stop >> 3] >> (stop & 7) & 1):
                    fits = last < 0 or pairs.get(last << 32 | piece)
                    if fits or fits is None and self.apart(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, last = stop, piece
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = out.pop()
                at -= sizes[piece]  # its end is marked, so a shorter one is taken
                last = out[-1] if out else -1
        return out

    def encode_part(self, part: str) -> list[int]:
        """The ids of a text in which spaces stand for themselves."""
        if self.characters.issuperset(part):
            return self.cover(part)
        out, start = [], 0
        for k, c in enumerate(part):
            if c not in self.ids:
                out += self.cover(part[start:k]) if k > start else []
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                start = k + 1
        return out + (self.cover(part[start:]) if start < len(part) else [])

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        coded = [self.encode_part(p.decode("utf-8", "replace")) for p in parts]
        flat, at = np.array([i for c in coded for i in c], "<u4").tobytes(), np.cumsum([0, *map(len, coded)]) * 4
        return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, without begin and end, and how many each has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ").cast(pa.large_string())
        if self.prefix:
            empty = pc.equal(pc.binary_length(texts), 0)
            texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
        ends = np.cumsum(sizes)
        start = np.zeros(max(2, len(raw) + 1), bool)
        start[(ends - sizes)[sizes > 0]] = True
        start[1:-1] |= self.cut[raw[:-1], raw[1:]]
        at = np.flatnonzero(start[: len(raw)])
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        found = self.known.get_all(coded.dictionary.to_pylist(), self._learn)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, n = _gathered(np.frombuffer(b"".join(found), "<u4"), lengths, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(upto[np.searchsorted(at, np.concatenate([[0], ends]))])


def pieces(path: str, kind: type = Pieces):
    """The model, read once a worker: ``Surface`` to decode, ``Pieces`` to encode too."""
    if (path, kind) not in _models:
        _models[path, kind] = kind(path)
    return _models[path, kind]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` of every row: all ids of its whole text, with those of begin and end."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for b in portions(whole):
                ids, n = own.encode(plain(b.column("text")))
                at = np.cumsum(n)
                ids = np.insert(ids, np.stack([at - n, at], 1).ravel(), np.tile(np.array([own.begin, own.end], ids.dtype), len(n)))
                offsets = np.concatenate([[0], np.cumsum(n + 2)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([plain(b.column("id")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def _digests(flat: np.ndarray, n: np.ndarray, texts: list[bytes | None]) -> list[pa.Array]:
    raw, at = flat.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
    sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
    return [pa.array(n.astype(np.int64)), pa.array(sha), pa.array([hashlib.sha256(t or b"").hexdigest() for t in texts], pa.string())]


def decode(encoded: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """``id, ids, text`` of rows with ``id, ids``.

    digest: ``id, n_tokens, ids_sha256, decoded_sha256`` instead; ids count as little-endian 32-bit integers.
    """
    bound_batches(encoded.sparkSession)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["id", "ids", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, Surface)
        for b in batches:
            lists = plain(b.column("ids"))
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = [t if k else None for t, k in zip(own.decode(flat, n), pc.is_valid(lists).to_pylist(), strict=True)]
            told = _digests(flat, n, texts) if digest else [lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([plain(b.column("id")), *told], names)

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, text string"))


def op13_piece_bpe(spark, sf_dir, model: str | None = None):
    """Every whole document encoded with begin and end ids, decoded again, and both digested."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    return decode(encode(docs, model), model, digest=True).withColumnRenamed("id", "doc_id")
