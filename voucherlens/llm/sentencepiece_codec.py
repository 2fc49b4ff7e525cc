r"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

The segmentation is the one with the highest sum of piece scores. The automaton reads the text
once; at each position the output links of its state give every piece that ends there, and each
relaxes the best score of that position. A character no piece covers is spelt with byte pieces,
at a score below that of any piece, as SentencePiece does with its unigram models. Ties go to
the longer last piece.

Text is prepared as the model's file says (identity normalisation, white space kept): a space
becomes the mark U+2581 and one mark goes in front of a non-empty text. A U+2581 that is in the
text itself is spelt in bytes, so decoding gives back exactly what was encoded. No piece has the
mark after another character, so a best segmentation is a row of best segmentations of the
units ``mark* other+``; units of up to ``MEMO_CHARS`` characters are memoised in a table per Python
worker that is bounded in bytes. Longer ones (a text without spaces is one unit) are segmented
every time, in typed arrays of 16 bytes a character.

Edge cases: null and empty texts give no tokens and decode to the empty text; texts are encoded
whole, however long; ids that are no byte or ordinary piece (unknown, begin, end) decode to
nothing; byte pieces that are no valid UTF-8 decode to U+FFFD; repeated rows get equal results;
an empty table gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, kept, schema_with, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_BYTES = 64 << 20   # for each of two generations
MEMO_CHARS = 64
ENTRY_BYTES = 250       # what an entry takes beside its characters and ids
BLOCK_UNITS = 1 << 16   # of one text at most so many units are looked up before the memo is cut
# A mark that stands for itself while a text is prepared: a code point UTF-8 cannot hold.
_LITERAL = "\ud800"


class PieceModel:
    """Pieces with scores, and the automaton over them."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], special: set[int]):
        """``pieces[i]`` is (text, score) of id ``i``; special ids never match text."""
        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.special = special
        usable = [s for i, (_, s) in enumerate(pieces)
                  if i not in special and i not in self.byte_of]
        # Fixed value: how far below the worst piece an uncovered character scores.
        self.unknown = min(usable, default=0.0) - 10.0
        self.goto: list[dict[str, int]] = [{}]
        self.own: list[int] = [-1]       # the piece that ends in a state, as a whole path
        self.depth = [0]
        for i, (text, _) in enumerate(pieces):
            if i in special or i in self.byte_of or not text:
                continue
            state = 0
            for c in text:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.own.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = self.goto[state][c]
            if self.own[state] < 0 or pieces[self.own[state]][1] < pieces[i][1]:
                self.own[state] = i
        self._link()

    @classmethod
    def parse(cls, proto: bytes) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = p.get_piece_size()
        byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        return cls([(p.id_to_piece(i), p.get_score(i)) for i in range(n)], byte_ids, special)

    def _link(self) -> None:
        """Failure links, and per state the pieces that end there: (length, score, id)."""
        n = len(self.goto)
        self.fail, out = [0] * n, [()] * n
        queue = deque(self.goto[0].values())
        for s in self.goto[0].values():
            out[s] = self._piece(s)
        while queue:
            state = queue.popleft()
            for c, to in self.goto[state].items():
                f = self.fail[state]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[to] = self.goto[f].get(c, 0)
                out[to] = self._piece(to) + out[self.fail[to]]
                queue.append(to)
        self.out = out  # longest piece first, along the output links

    def _piece(self, state: int) -> tuple:
        i = self.own[state]
        return () if i < 0 else ((self.depth[state], self.pieces[i][1], i),)

    def best(self, unit: str) -> list[int] | array:
        """Ids of the best segmentation of a prepared text, in one pass over it."""
        goto, fail, out = self.goto, self.fail, self.out
        n = len(unit)
        if n <= MEMO_CHARS:
            score, start_of, piece_of, ids = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), []
        else:  # the same in 8 + 4 + 4 bytes a character, and 4 an id
            score = array("d", bytes(8 * (n + 1)))
            start_of, piece_of = (array("i", bytes(4 * (n + 1))) for _ in range(2))
            ids = array("i")
        state = 0
        for at, c in enumerate(unit, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, start, via = None, at - 1, -1
            for length, value, piece in out[state]:
                value += score[at - length]
                if top is None or value > top:
                    top, start, via = value, at - length, piece
            if via < 0 or start != at - 1:
                # A single character may always be spelt out, unless it is a piece itself.
                single = goto[0].get(c, 0)
                if not single or self.own[single] < 0:
                    value = score[at - 1] + self.unknown
                    if top is None or value > top:
                        top, start, via = value, at - 1, -1
            score[at], start_of[at], piece_of[at] = top, start, via
        at = n
        while at:
            start, piece = start_of[at], piece_of[at]
            if piece >= 0:
                ids.append(piece)
            else:
                c = unit[start]
                spelt = MARK.encode() if c == _LITERAL else c.encode()
                ids.extend(self.byte_ids[b] for b in reversed(spelt))
            at = start
        ids.reverse()
        return ids


def prepare(text: str) -> str:
    if not text:
        return ""
    return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)


class Codec:
    """Encoder and decoder with two generations of memoised units, about ``memo`` bytes in each."""

    def __init__(self, model: PieceModel, memo: int = MEMO_BYTES):
        self.model, self.limit, self.used = model, memo, 0
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.text_of = [b"" if i in model.special
                        else bytes([model.byte_of[i]]) if i in model.byte_of
                        else t.replace(MARK, " ").encode()
                        for i, (t, _) in enumerate(model.pieces)]

    def encode(self, text: str) -> np.ndarray:
        units = _UNITS.findall(prepare(text))
        parts = [self._encode_units(units[a:a + BLOCK_UNITS])
                 for a in range(0, len(units), BLOCK_UNITS)]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def _encode_units(self, units: list[str]) -> bytes:
        memo, long_units = self.memo, {}
        for u in set(units).difference(memo):
            ids = self.older.get(u)
            if ids is None:
                ids = array("i", self.model.best(u)).tobytes()
            if len(u) > MEMO_CHARS:
                long_units[u] = ids
            else:
                memo[u] = ids
                self.used += ENTRY_BYTES + 4 * len(u) + len(ids)
        if long_units:
            out = b"".join([memo[u] if u in memo else long_units[u] for u in units])
        else:
            out = b"".join(map(memo.__getitem__, units))
        if self.used > self.limit:  # keep what was used lately, forget what was not
            self.memo, self.older, self.used = {}, memo, 0
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec_for(proto: bytes) -> Codec:
    """One codec per worker and model: the memo outlives the task, until another operator's task."""
    codecs = kept("sentencepiece")
    if proto not in codecs:
        codecs.clear()
        codecs[proto] = Codec(PieceModel.parse(proto))
    return codecs[proto]


def load_model(path: str = MODEL_PATH) -> bytes:
    """The model file; its size is fixed by the vocabulary, not by the data."""
    with open(path, "rb") as f:
        return f.read()


def _ids_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


# Rows put into one output batch at most so many ids, so that long texts do not add up.
BATCH_IDS = 1 << 21


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and whether decoding them gives the text again."""
    texts = id_and_text(docs, id_col, text_col)
    proto = texts.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(proto.value)
        for batch in batches:
            at, parts, same, size = 0, [], [], 0

            def flush(at=0):
                return pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(at, len(parts)),
                    "n_tokens": pa.array([len(p) for p in parts], pa.int64()),
                    "ids": _ids_array(parts), "round_trip": pa.array(same, pa.bool_())})

            for value in batch.column("text"):
                text = value.as_py()
                parts.append(codec.encode(text))
                same.append(codec.decode(parts[-1].tolist()) == text)
                size += len(parts[-1])
                if size >= BATCH_IDS:
                    yield flush(at)
                    at, parts, same, size = at + len(parts), [], [], 0
            if parts:
                yield flush(at)

    return texts.mapInArrow(run, schema_with(
        texts, "n_tokens bigint", "ids array<int>", "round_trip boolean"))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id`` and the ``text`` that the ids spell; null ids are no ids."""
    rows = encoded.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    proto = rows.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(proto.value)
        for batch in batches:
            texts = [codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, schema_with(rows, "text string"))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
