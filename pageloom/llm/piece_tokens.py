"""SentencePiece merge-type encoding by backtracking, and its decoding.

The encoder does not merge a text from its characters. One Aho-Corasick scan of a unit of text finds the
pieces that start at every place. The longest is tried first; it stands if it can follow the piece before
it, which holds exactly if merging the text of the two anew gives these two pieces again. If none can stand,
the place is marked in a bitfield of failed places and the last piece gives way to a shorter one. A sequence
whose every two adjacent pieces agree in this way is the merge encoding of its text, so the result is exact.

Units are what no piece reaches beyond: blanks, then other signs, then letters. That holds for models with no
piece in which a blank follows another character or a sign follows a letter, which ``load_model`` checks.
Models without that, or with another normaliser than the identity with a blank put first, are refused and
not approximated.
"""

from __future__ import annotations

import codecs
import heapq
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
#: Units and pairs of pieces that a worker remembers (twice as many units at most), the longest unit remembered.
MOST_UNITS, MOST_PAIRS, LONGEST_UNIT = 1 << 17, 1 << 19, 40
#: Bytes of text encoded at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Latin, Greek and Cyrillic letters; what is none of them counts as a sign.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
#: Blanks, then signs, then letters; a line end alone. The last match of a text is empty.
UNIT = re.compile(rf"\n|{BLANK}*[^{LETTERS}{BLANK}\n]*[{LETTERS}]*")
_CROSSING = re.compile(rf"[^{BLANK}]{BLANK}|[{LETTERS}][^{LETTERS}]|\n.|.\n", re.DOTALL)

codecs.register_error("pageloom_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def load_model(path: str) -> dict:
    """The pieces of a merge-type model file, with their scores: a few hundred kB, sent to the tasks.

    Raises ValueError for models that this encoder does not cover.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if model.normalize(" a  b ﬁÅ\n ") != "▁▁a▁▁b ﬁÅ\n▁":
        raise ValueError("the normaliser of the model changes texts")
    if any(model.is_unused(i) for i in ids):
        raise ValueError("the model has unused pieces")
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    pieces = {model.id_to_piece(i): i for i in ids if i not in special}
    single = {p for p in pieces if len(p) == 1}
    if any(_CROSSING.search(p) for p in pieces) or any(c not in single for p in pieces for c in p):
        raise ValueError("pieces cross the borders of units or hold characters that are no pieces")
    by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError("the model has no piece for every byte")
    return {
        "pieces": pieces, "scores": {i: model.get_score(i) for i in pieces.values()}, "by_byte": [by_byte[b] for b in range(256)],
        "control": [i for i in ids if model.is_control(i)], "unknown": [i for i in ids if model.is_unknown(i)], "end": model.eos_id(), "size": len(ids),
    }


class _Units(dict):
    """Ids of units by text: the younger of two halves; what is found in the older one comes back to the younger."""

    def __init__(self, encode) -> None:
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) <= LONGEST_UNIT:
            if len(self) >= MOST_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class PieceCodec:
    """Encodes and decodes texts with the pieces of ``load_model``."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.pieces, self.scores, self.by_byte, self.end = model["pieces"], model["scores"], model["by_byte"], model["end"]
        self.lengths = {i: len(p) for p, i in self.pieces.items()}
        self.texts = {i: p for p, i in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.agree, self.units = {}, _Units(self.encode_unit)
        self.shown = [b""] * model["size"]
        for piece, i in self.pieces.items():
            self.shown[i] = piece.replace(BLANK, " ").encode()
        for byte, i in enumerate(self.by_byte):
            self.shown[i] = bytes([byte])
        for i in model["unknown"]:
            self.shown[i] = " ⁇ ".encode()
        self.hidden = set(model["control"])
        self.plain = set(self.pieces.values())

    # -- encoding

    def merge(self, text: str) -> list[int]:
        """The merge encoding of a text of known characters: best score first, leftmost of equal ones."""
        parts, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap, pieces, scores = [], self.pieces, self.scores

        def offer(a: int, b: int) -> None:
            made = pieces.get(parts[a] + parts[b])
            if made is not None:
                heapq.heappush(heap, (-scores[made], a, b, len(parts[a]) + len(parts[b])))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size or right[a] != b:
                continue
            parts[a], parts[b] = parts[a] + parts[b], ""
            right[a] = right[b]
            if right[a] < len(text):
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [pieces[p] for p in parts if p]

    def follows(self, first: int, second: int) -> bool:
        """Whether merging the text of two pieces anew gives just these two; remembered."""
        if len(self.agree) >= MOST_PAIRS:
            self.agree.clear()
        found = self.agree[first << 32 | second] = self.merge(self.texts[first] + self.texts[second]) == [first, second]
        return found

    def backtrack(self, starts: list[list[int]]) -> list[int]:
        """The encoding, from the pieces starting at every place in ascending length."""
        n, lengths, agree = len(starts), self.lengths, self.agree
        failed = bytearray((n >> 3) + 1)
        taken, rest = [], []  # the pieces so far, and how many shorter ones each leaves
        at, k, last = 0, len(starts[0]), -1
        while at < n:
            options = starts[at]
            while k:
                k -= 1
                piece = options[k]
                end = at + lengths[piece]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last >= 0:
                    fits = agree.get(last << 32 | piece)
                    if not (self.follows(last, piece) if fits is None else fits):
                        continue
                taken.append(piece)
                rest.append(k)
                at, last = end, piece
                k = len(starts[at]) if at < n else 0
                break
            else:
                if not taken:
                    raise ValueError("no sequence of agreeing pieces covers the text")
                failed[at >> 3] |= 1 << (at & 7)
                at -= lengths[taken.pop()]
                k = rest.pop()
                last = taken[-1] if taken else -1
        return taken

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit; a character that is no piece stands as its UTF-8 bytes."""
        lengths = self.lengths
        starts: list[list[int]] = [[] for _ in unit]
        for last, piece in self.automaton.iter(unit):
            starts[last + 1 - lengths[piece]].append(piece)
        if all(starts):
            return tuple(self.backtrack(starts)) if unit else ()
        ids, first = [], 0  # no piece holds an unknown character, so nothing reaches beyond it
        for cut in [*(k for k, found in enumerate(starts) if not found), len(unit)]:
            if first < cut:
                ids += self.backtrack(starts[first:cut])
            ids += [self.by_byte[b] for b in unit[cut : cut + 1].encode()]
            first = cut + 1
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text with the end id; of a null those of the empty text."""
        if not text:
            return [self.end]
        units = UNIT.findall(BLANK + text.replace(" ", BLANK))
        return [*chain.from_iterable(map(self.units.__getitem__, units)), self.end]

    # -- decoding

    def decode(self, ids) -> str:
        """The text of ids: control ids show nothing, a byte that starts no character shows U+FFFD, and the blank put first goes."""
        ids = list(ids or ())
        while ids and ids[-1] in self.hidden:
            ids.pop()
        if self.hidden.isdisjoint(ids):
            runs = [ids]
        else:  # bytes on either side of a control id make no character together
            runs = [[]]
            for i in ids:
                runs[-1].append(i) if i not in self.hidden else runs.append([])
        text = "".join([b"".join(map(self.shown.__getitem__, run)).decode("utf-8", "pageloom_each_byte") for run in runs])
        first = next(chain.from_iterable(runs), None)
        return text[1:] if first in self.plain and text[:1] == " " else text


_CODECS: dict[str, PieceCodec] = {}


def _codec(shared) -> PieceCodec:
    """One codec a worker for a broadcast model, so that units stay known between its tasks."""
    key = str(shared.value["key"])
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(shared.value)
    return _CODECS[key]


def _shared_model(df: DataFrame, model_path: str):
    """The model as a broadcast: at most some MB, whatever the input, as a vocabulary is fixed."""
    model = load_model(model_path)
    if model["size"] > 1_000_000:
        raise ValueError("a vocabulary of over a million pieces is not sent to the tasks")
    return df.sparkSession.sparkContext.broadcast(model | {"key": model_path})


def _blocks(batch, column: str):
    """Row ranges of a batch with about BLOCK_BYTES of the column each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > BLOCK_BYTES:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def _int_lists(rows: list[list[int]]):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _added(df: DataFrame, **fields: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(*fields)
    return kept, T.StructType([*kept.schema.fields, *(T.StructField(n, kind) for n, kind in fields.items())])


def encode_texts(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with the ids of its whole text as ``ids`` (array<int>), the end id last.

    A null text counts as empty; its ids are the end id alone. Equal texts have equal ids, rows are
    neither merged nor dropped, an empty table stays empty, and a column of the name ``ids`` is replaced.
    Texts of any length are encoded whole, in blocks of rows of about 2 MB. ``model_path`` is read by the
    driver only.
    """
    kept, schema = _added(df, **{ids: T.ArrayType(T.IntegerType())})
    shared = _shared_model(df, model_path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for block in _blocks(batch, text):
                yield block.append_column(ids, _int_lists([codec.encode(t) for t in block.column(text).to_pylist()]))

    return kept.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row with the text of its ids as ``text``; null ids give the empty text, unknown numbers an error."""
    kept, schema = _added(df, **{text: T.StringType()})
    shared = _shared_model(df, model_path)

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared)
        for batch in batches:
            for first in range(0, len(batch), 256):
                block = batch.slice(first, 256)
                yield block.append_column(text, pa.array([codec.decode(r) for r in block.column(ids).to_pylist()], pa.string()))

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass over the rows; the text itself is left behind."""
    source, _ = _added(df, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()})
    schema = T.StructType([f for f in source.schema.fields if f.name != text] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    shared = _shared_model(df, model_path)

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared)
        for batch in batches:
            for block in _blocks(batch, text):
                found = [codec.encode(t) for t in block.column(text).to_pylist()]
                block = block.drop_columns([text])
                yield block.append_column(ids, _int_lists(found)).append_column(decoded, pa.array([codec.decode(r) for r in found], pa.string()))

    return source.mapInArrow(run, schema)


def digests(coded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded texts."""
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
