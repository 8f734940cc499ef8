"""SentencePiece BPE without merge simulation: a prefix table over automaton matches.

For every prefix of a chunk there is exactly one token that its encoding can end with.  The table
stores that token.  A token t that ends at position i, as the automaton over all pieces reports it,
is the one if the encoding of what is before t ends with a token that may stand before t.  Whether
two tokens may be neighbours depends on the two alone (`Vocabulary.compatible`), so the table is
filled from left to right in one pass, and the ids are recovered from its end backwards.

A text is cut where no piece can reach across: no piece holds a word mark after another character
and none holds a line feed.  Runs of two or more word marks are pieces of equal score, for which
positions and not only scores order the merges; such chunks take the merge queue (`Vocabulary.merged`),
as does any chunk for which the table finds no single answer.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Kinds of pieces in the model's file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A worker keeps at most so many encoded chunks and pair verdicts.
CACHE = 400_000
PAIRS = 1_000_000
PAIR = 1_000_003  # above any id
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """The pieces of one SentencePiece BPE model, with the tables that encoding needs."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("the model's normalisation must be the identity")
        self.prefix = bool(n.add_dummy_prefix)
        self.text = [p.piece for p in spec.pieces]
        self.kind = [p.type for p in spec.pieces]
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == "</s>")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (NORMAL, USER)}
        self.chars = {p for p in self.id if len(p) == 1}
        self.score = [p.score for p in spec.pieces]
        self._compat: dict[int, bool] = {}
        self._split()

    def _split(self) -> None:
        """For each piece its last merge and the time of it (low is early); pieces that merging never makes are left out."""
        import ahocorasick

        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, float] = {}
        self.matcher = ahocorasick.Automaton()
        for piece, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                self.time[i] = float("-inf")
            elif piece.startswith(MARK * 2):
                continue
            else:
                ids, last = self._merge(piece)
                if ids != [piece] or last is None:
                    continue
                a, b = (self.id[x] for x in last)
                self.left[i], self.right[i] = a, b
                self.time[i] = max(-self.score[i], self.time.get(a, 0), self.time.get(b, 0))
            self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Best-score merging with a queue: the symbols left, and the last pair that was merged."""
        at: list[str | None] = list(text)
        prev, nxt = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.id.get(both := at[i] + at[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, j, len(both)))

        for i in range(len(at) - 1):
            offer(i, i + 1)
        last = None
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if at[i] is None or at[j] is None or nxt[i] != j or len(at[i]) + len(at[j]) != size:
                continue
            last = (at[i], at[j])
            at[i], at[j] = at[i] + at[j], None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i], i)
            offer(i, nxt[i])
        return [x for x in at if x is not None], last

    def _ids(self, symbol: str) -> list[int]:
        i = self.id.get(symbol)
        return [i] if i is not None else [self.byte[b] for b in symbol.encode()]

    def merged(self, chunk: str) -> list[int]:
        """Ids of a chunk by the merge queue."""
        return [i for s in self._merge(chunk)[0] for i in self._ids(s)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between the neighbours a and b alone."""
        key = a * PAIR + b
        if (known := self._compat.get(key)) is None:
            if len(self._compat) >= PAIRS:
                self._compat.clear()
            known = self._compat[key] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        # What stands beside the border, back in time: the right spine of a, the left spine of b.
        # The pair that meets there in each state must not merge before one side grows.
        grown_a = grown_b = float("inf")
        while True:
            both = self.id.get(self.text[a] + self.text[b])
            if both is not None:
                cross = max(-self.score[both], self.time[a], self.time[b])
                # On equal times the pair further left merges first.
                if cross < grown_a and cross <= grown_b:
                    return False
            if self.time[a] == self.time[b] == float("-inf"):
                return True
            # Undo the later of the two merges; of equal times, the one further right.
            if self.time[a] > self.time[b]:
                grown_a = self.time[a]
                a = self.right[a]
            else:
                grown_b = self.time[b]
                b = self.left[b]

    def table(self, chunk: str) -> list[int]:
        """Ids of a chunk by the prefix table; where it gives no answer, by the merge queue."""
        if not self.chars.issuperset(chunk):
            return self._table_with_bytes(chunk)
        n = len(chunk)
        last, size_of, known, filled = [-1] * (n + 1), [0] * (n + 1), self._compat, 0
        for end, (size, i) in self.matcher.iter(chunk):
            end += 1
            if filled >= end:
                continue  # each prefix has one last token, and this one's is found
            if size < end:
                before = last[end - size]
                if before < 0:
                    continue
                fits = known.get(before * PAIR + i)
                if fits is None:
                    fits = self.compatible(before, i)
                if not fits:
                    continue
            last[end], size_of[end], filled = i, size, end
        ids: list[int] = []
        while n:
            if last[n] < 0:
                return self.merged(chunk)
            ids.append(last[n])
            n -= size_of[n]
        ids.reverse()
        return ids

    def _table_with_bytes(self, chunk: str) -> list[int]:
        """The same around characters outside the vocabulary: nothing merges with them."""
        ids, start = [], 0
        for k, c in enumerate(chunk):
            if c not in self.chars:
                ids += (self.table(chunk[start:k]) if k > start else []) + [self.byte[b] for b in c.encode()]
                start = k + 1
        return ids + (self.table(chunk[start:]) if start < len(chunk) else [])

    def encode_chunk(self, chunk: str) -> list[int]:
        return self.merged(chunk) if MARK * 2 in chunk else self.table(chunk)

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, with word marks as spaces and bytes joined; the text's added first space stays."""
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if self.kind[i] != CONTROL:
                out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


class Recent(dict):
    """A memo of bounded size: when it is full, the entries used since the last time stay."""

    def __init__(self, made, size: int, longest: int):
        super().__init__()
        self.made, self.half, self.longest, self.older = made, size // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _all_of(v: Vocabulary):
    def made(chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal, decoded text."""
        ids = v.encode_chunk(chunk)
        return len(ids), " ".join(map(str, ids)), v.decode_ids(ids)

    return made


_LOADED: dict[str, Vocabulary] = {}
_CACHES: dict[str, Recent] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The model's tables, built once in each Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def encoded(model: bytes) -> Recent:
    key = hashlib.sha256(model).hexdigest()
    if key not in _CACHES:
        _CACHES[key] = Recent(_all_of(vocabulary(model)), CACHE, 64)
    return _CACHES[key]


def chunks(text: str, prefix: bool) -> list[str]:
    """The parts that encode independently; the added first space belongs to the first."""
    return CHUNK.findall((MARK + text if prefix and text else text).replace(" ", MARK))


def encode(text: str, model: bytes, end: bool = True) -> list[int]:
    """Ids of one text, as the operator computes them."""
    v = vocabulary(model)
    ids = [i for c in chunks(text, v.prefix) for i in v.encode_chunk(c)]
    return [*ids, v.end] if end else ids


def decode(ids: list[int], model: bytes) -> str:
    v = vocabulary(model)
    text = v.decode_ids(ids)
    return text[1:] if v.prefix and text.startswith(" ") else text


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; by default the public 32k BPE model installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode whole texts with an end id, decode them again, and return a digest of both.

    One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also
    ids array<int> and decoded string.  A null text counts as empty: one id (the end), decoded to
    "".  A null id stays null.  Repeated rows give repeated rows; an empty table gives none.  Other
    columns, whatever their names, are not read.  The model's bytes (0.5 MB, fixed) go out with the
    tasks; no shuffle, and memory is one Arrow batch plus a cache of bounded size."""
    model = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoded(model)
        v = vocabulary(model)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 if keep_ids else 4)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                done = [cache[c] for c in chunks(text.as_py() or "", v.prefix)]
                ids = " ".join([x[1] for x in done] + [str(v.end)])
                back = "".join([x[2] for x in done])
                if v.prefix and back.startswith(" "):
                    back = back[1:]
                made = [i, sum(x[0] for x in done) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                if keep_ids:
                    made += [list(map(int, ids.split())), back]
                for col, x in zip(rows, made):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names[: len(rows)])

    schema = OUT + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
