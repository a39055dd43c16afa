"""Operator 4: SentencePiece BPE encoding and decoding with a merge-type prefix table.

Greedy BPE gives every prefix of a text exactly one last token.  An automaton
over all pieces reports the tokens that end at each position; token ``t`` that
starts at ``s`` is the last one of that prefix when it is compatible with the
last token of the prefix ending at ``s``: no merge across their border would
have come before the merges that made the two.  The ids are then read backwards
from the end of the table.  No piece of such a model holds a space mark behind
another character, so texts are cut before each run of spaces and every
distinct cut is encoded once per worker process.

Defined results: null and empty text have no ids and decode to ""; each row
is handled by itself, so repeated rows and ids give repeated results; columns
other than the id and the text are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

SPACE = "▁"
CUT = ""
CHUNKS = regex.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Entries of each of the two generations of the per-process cache, the longest text that goes in, and the characters encoded at a time.
CACHE, CACHED_CHARS, PART = 350_000, 48, 1 << 20


class PrefixTable:
    """A BPE model of SentencePiece with identity normalisation, as automaton, merge ranks and splits."""

    def __init__(self, path: str) -> None:
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = spm.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback:
            raise ValueError("needs a BPE model with identity normalisation, a dummy prefix, kept spaces and byte fallback")
        n = sp.get_piece_size()
        if any(p.type in (pb.ModelProto.SentencePiece.USER_DEFINED, pb.ModelProto.SentencePiece.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte_id = {}
        pieces: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * n
        self.is_byte = np.zeros(n, dtype=bool)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
                self.is_byte[i] = True
            elif sp.is_unknown(i):
                self.unknown = i
                self.surface[i] = train.unk_surface.encode()
            elif not sp.is_control(i):
                if SPACE in p.lstrip(SPACE):
                    raise ValueError("a piece holds a space mark behind another character")
                q = p.replace(SPACE, " ")
                pieces[q] = i
                self.surface[i] = q.encode()
        self.known = {p for p in pieces if len(p) == 1}
        order = sorted((i for p, i in pieces.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = dict.fromkeys(pieces.values(), -1) | {i: r for r, i in enumerate(order)}
        self.pair: dict[tuple[int, int], int] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    self.pair[a, b] = i
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in pieces.items():
            if self._merges_to_itself(p, i, pieces):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.length = {i: len(p) for p, i in pieces.items()}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        lengths = np.array([len(s) for s in self.surface], dtype=np.int64)
        self.sizes, self.begins = lengths, np.cumsum(lengths) - lengths
        self.table = np.frombuffer(b"".join(self.surface), dtype=np.uint8)

    def _merges_to_itself(self, piece: str, i: int, pieces: dict[str, int]) -> bool:
        """Whether merging the piece's characters ends in it; notes its last merge."""
        if not self.known.issuperset(piece):
            return False
        parts = [pieces[c] for c in piece]
        while len(parts) > 1:
            best = min(((self.rank[m], k) for k in range(len(parts) - 1) if (m := self.pair.get((parts[k], parts[k + 1]))) is not None), default=None)
            if best is None:
                return False
            k = best[1]
            merged = self.pair[parts[k], parts[k + 1]]
            if len(parts) == 2 and merged == i:
                self.left[i], self.right[i] = parts
            parts[k : k + 2] = [merged]
        return parts == [i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: undo the later merge again and again, and see if one across the border would have come first."""
        limit = 1 << 30
        rank, pair = self.rank, self.pair
        while True:
            across = pair.get((a, b))
            if across is not None and rank[across] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def _known_ids(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last = [-1] * (len(text) + 1)
        fits, length = self.fits, self.length
        for at, (token, size) in self.automaton.iter(text):
            end = at + 1
            if last[end] < 0:
                start = end - size
                if start == 0:
                    last[end] = token
                else:
                    before = last[start]
                    key = before << 20 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > 500_000:
                            fits.clear()
                        ok = fits[key] = self.compatible(before, token)
                    if ok:
                        last[end] = token
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= length[last[end]]
        ids.reverse()
        return ids

    def chunk_ids(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self._known_ids(text)
        ids: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > start:
                    ids += self._known_ids(text[start:k])
                ids += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        return ids + (self._known_ids(text[start:]) if start < len(text) else [])

    def __getitem__(self, chunk: str) -> bytes:
        got = self.cache.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                ids = self.chunk_ids(chunk)
                got = pack(f"<{len(ids)}i", *ids)
            if len(chunk) <= CACHED_CHARS:
                if len(self.cache) >= CACHE:
                    self.older, self.cache = self.cache, {"": b""}
                self.cache[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, as the library's ``encode`` without begin and end ids."""
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text.replace(SPACE, " ")
        done = []
        get = self.__getitem__
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > PART:
                cut = regex.compile(r"(?<! ) ").search(text, at + PART)
                to = cut.start() if cut else to
            part = text if to - at == len(text) else text[at:to]
            at = to
            if "  " in part or CUT in part:
                chunks = CHUNKS.findall(part)
            else:
                chunks = part.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}").split(CUT)
            try:
                done.append(b"".join(map(self.cache.__getitem__, chunks)))
            except KeyError:
                done.append(b"".join(map(get, chunks)))
        return np.frombuffer(b"".join(done), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the library's ``decode(ids)``."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        raw = self.table[source].tobytes()
        head = 0
        while head < len(ids) and sizes[head] == 0:
            head += 1
        if raw[:1] == b" " and not self.is_byte[ids[head]] and ids[head] != self.unknown:
            raw = raw[1:]
        if self.is_byte[ids].any():
            if (sizes == 0).any():
                return self._decode_broken(ids)
            try:
                raw.decode()
            except UnicodeDecodeError:
                return self._decode_broken(ids)
        return raw

    def _decode_broken(self, ids: np.ndarray) -> bytes:
        """Byte pieces that are no UTF-8, or that control ids part: each stray byte becomes U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + size]).decode().encode())
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    k += 1
            run.clear()

        first = True
        for i in map(int, ids):
            if self.is_byte[i]:
                run += self.surface[i]
                first = False
                continue
            flush()
            s = self.surface[i]
            out.append(s[1:] if first and s[:1] == b" " and i != self.unknown else s)
            first = first and not s
        flush()
        return b"".join(out)


_TABLES: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """The model of a path, built once per process."""
    if path not in _TABLES:
        _TABLES[path] = PrefixTable(path)
    return _TABLES[path]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in slices(batches):
            ids = [t.encode(x or "") for x in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for a table with ``doc_id`` and id lists; null lists count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = part.column(1)
                if lists.null_count:
                    lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                texts = [t.decode(flat[ends[i] : ends[i + 1]]) for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])

    picked = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, text string")
