"""Byte-level BPE by dynamic programming over prefixes.

A byte string has one encoding, so each of its prefixes has one last token. That token ends the prefix, starts where a
shorter prefix ends, and may follow the last token of that shorter prefix: no merge across the border between the two
would have come before the merges that made them. Of all tokens that end at a byte exactly one is so, and whether one is
depends on the longest token's length of bytes before it and on nothing else. An appended text therefore goes on where the
table ends, and an edit is followed by new entries only until the table agrees with the old one over one longest token.

Text is first cut into pieces by a pattern; a piece's table does not look beyond the piece. `encode` and `decode` work
on whole texts; `prefix_table` stores the last tokens, and `re_encode` takes edits and appended texts to them.

Defined cases: a null text counts as empty and has no tokens; texts are encoded whole, however long, in stretches of pieces; strings
of special tokens are plain text; rows that repeat are encoded each for itself; ids need no keys and may be null or tie; an empty
table gives an empty result; other columns pass through, and one named like an added column gets `_` behind its name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside

#: Distinct pieces whose tokens a Python worker remembers, the longest piece that it does, and pairs of tokens whose border it has judged.
REMEMBERED, REMEMBERED_LENGTH, JUDGED = 500_000, 64, 1_000_000

#: Prefixes of pieces whose last token a worker stores.
PREFIXES = 500_000

#: Bytes of a piece from which on its whole table is made, prefix by prefix; of a shorter one only the entries that its tokens lead to.
WHOLE_TABLE = 256

#: Characters of a text from which on its pieces are taken in stretches, and pieces of a stretch.
LONG_TEXT, STRETCH = 1 << 20, 1 << 15

#: Characters behind a piece's end that can decide where it ends: a contraction has three characters.
LOOK_AHEAD = 3

#: Codecs of this process by vocabulary and pattern; Spark's workers go on from task to task.
_CODECS: dict[tuple, Codec] = {}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their ids from a rank file. Driver only; a vocabulary is bounded by its ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(i) for _, i in pairs))
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


class Remembered(dict):
    """Tokens of pieces, computed when they are first asked for. When there are too many, those not asked for since the last time go."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece) or self.compute(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """A vocabulary with what tells whether one token may follow another."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens) if t}
        self.cut = regex.compile(pattern)
        self.longest, self.sizes = max(map(len, tokens)), list(map(len, tokens))
        #: Tokens by their bytes from the last one on: the next node of each byte, and at -1 the token that a node stands for.
        self.root: dict = {}
        for t, i in self.ids.items():
            node = self.root
            for b in reversed(t):
                node = node.setdefault(b, {})
            node[-1] = i
        self.judged: dict[int, bool] = {}
        self.last: dict[bytes, int] = {}
        n = len(tokens)
        #: When a token is formed (bytes are there from the start), and the two tokens that its last merge joins.
        self.formed, self.left, self.right, self.merged = [-1 if len(t) == 1 else n for t in tokens], [0] * n, [0] * n, {}
        for t, i in sorted(self.ids.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(t) > 1:
                self._split(t, i)
        self.known = Remembered(self.piece_ids)

    def _split(self, token: bytes, i: int) -> None:
        """Find the merge that forms a token: the one cut into two older tokens that may stand side by side until then."""
        for k in range(len(token) - 1, 0, -1):
            a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
            if a is not None and b is not None and self.formed[a] < i and self.formed[b] < i and self.may_follow(a, b):
                self.formed[i], self.left[i], self.right[i], self.merged[a, b] = i, a, b, i
                return
        raise ValueError(f"token {i} cannot be formed by merges")

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is these two tokens.

        The merges of both are taken back from the last one on. A pair that meets at the border must not merge while both
        exist: before the left one is joined to its left, or, as of equal pairs the left one comes first, up to and
        with the merge that joins the right one to its right.
        """
        formed, merged, until = self.formed, self.merged, 1 << 60
        while True:
            m = merged.get((a, b))
            if m is not None and m < until:
                return False
            if formed[a] > formed[b]:
                until, a = formed[a], self.right[a]
            elif formed[b] >= 0:
                until, b = formed[b] + 1, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """`may_follow`, remembered."""
        pair = a << 32 | b
        known = self.judged.get(pair)
        if known is None:
            if len(self.judged) >= JUDGED:
                self.judged.clear()
            known = self.judged[pair] = self.may_follow(a, b)
        return known

    def ending(self, piece: bytes, end: int) -> list[int]:
        """The tokens that end a prefix, the shortest first."""
        found, node, at = [], self.root, end
        while at:
            at -= 1
            node = node.get(piece[at])
            if node is None:
                break
            if -1 in node:
                found.append(node[-1])
        return found

    def last_token(self, piece: bytes, end: int) -> int:
        """The last token of one prefix, and of the shorter ones that it leads to. They are stored by their bytes, for all pieces that begin with them.

        The longest token is tried first. `ending` and `fits` are written out here, as this is what new pieces cost.
        """
        prefix = piece[:end]
        token = self.last.get(prefix)
        if token is not None:
            return token
        found, node, sizes, judged = [], self.root, self.sizes, self.judged
        for byte in prefix[::-1]:
            node = node.get(byte)
            if node is None:
                break
            if -1 in node:
                found.append(node[-1])
        for token in reversed(found):
            size = sizes[token]
            if size == end:
                break
            before = self.last_token(piece, end - size)
            fits = judged.get(before << 32 | token)
            if self.fits(before, token) if fits is None else fits:
                break
        if len(self.last) >= PREFIXES:
            self.last.clear()
        self.last[prefix] = token
        return token

    def last_tokens(self, piece: bytes, last: list[int] | None = None, old: tuple[list[int], int, int] | None = None) -> tuple[list[int], int]:
        """The last token of each prefix of a piece, and how many of them were computed.

        last: those of a first part, which are right already. old: entries of a piece with the same bytes at its end, how
        much longer this piece is, and from which prefix on the bytes are the same.
        """
        last = last or []
        at, computed, agree = len(last), 0, 0
        while at < len(piece):
            end = at + 1
            for token in reversed(self.ending(piece, end)):
                size = self.sizes[token]
                if size == end or self.fits(last[end - size - 1], token):
                    break
            last.append(token)
            computed += 1
            at = end
            if old is not None:
                entries, more, same = old
                # One longest token of equal entries over equal bytes: all that follows is equal too.
                agree = agree + 1 if end > same and end - more > 0 and entries[end - more - 1] == token else 0
                if agree >= self.longest and end - agree >= same:
                    last.extend(entries[end - more :])
                    break
        return last, computed

    def walk(self, last: list[int]) -> list[int]:
        """The tokens, from the last one back."""
        out, at, tokens = [], len(last), self.tokens
        while at:
            out.append(last[at - 1])
            at -= len(tokens[out[-1]])
        out.reverse()
        return out

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) > WHOLE_TABLE:
            return tuple(self.walk(self.last_tokens(data)[0]))
        out, at = [], len(data)
        while at:
            out.append(self.last_token(data, at))
            at -= self.sizes[out[-1]]
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        """Ids of a text. Pieces that are single tokens, or known, are looked up."""
        out = array("i")
        for some in [self.cut.findall(text)] if len(text) < LONG_TEXT else self._stretches(text):
            out.extend(chain.from_iterable(map(self.known.__getitem__, some)))
        return out

    def _stretches(self, text: str) -> Iterator[list[str]]:
        found = self.cut.finditer(text)
        while some := [m.group() for m in islice(found, STRETCH)]:
            yield some

    # --- stored tables: four bytes per byte of text; a piece's last entry is stored as its complement, below 0

    def table(self, text: str) -> list[int]:
        state: list[int] = []
        for m in self.cut.finditer(text):
            self._add(state, self.last_tokens(m.group().encode())[0])
        return state

    @staticmethod
    def _add(state: list[int], last: list[int]) -> None:
        state.extend(last)
        state[-1] = ~state[-1]

    def edited(self, text: str, state: list[int], at: int, removed: int, inserted: str) -> tuple[str, list[int], int]:
        """Text and table after `removed` characters at `at` gave way to others, and how many entries were computed."""
        at = min(max(at, 0), len(text))
        stop = min(at + max(removed, 0), len(text))
        new = text[:at] + inserted + text[stop:]
        # Pieces that end LOOK_AHEAD characters before the edit stay; the first new one starts behind them.
        keep = len(text[: max(at - LOOK_AHEAD, 0)].encode())
        while keep and state[keep - 1] >= 0:
            keep -= 1
        a, b = len(text[:at].encode()), len(text[:stop].encode())
        more = len(inserted.encode()) - (b - a)
        out, computed, start = state[:keep], 0, len(text.encode()[:keep].decode())
        plain = lambda entries: [x if x >= 0 else ~x for x in entries]
        for m in self.cut.finditer(new, start):
            piece = m.group().encode()
            s, e = len(out), len(out) + len(piece)
            old_end = e - more
            # A new piece that starts where an old one did has that one's entries before the edit.
            known = plain(state[s:min(a, e)]) if s < a and (s == 0 or state[s - 1] < 0) and not any(x < 0 for x in state[s : min(a, e) - 1]) else []
            old = None
            if e > a + len(inserted.encode()) and 0 < old_end <= len(state) and state[old_end - 1] < 0:
                begin = old_end - 1
                while begin and state[begin - 1] >= 0:
                    begin -= 1
                # Entries of the old piece by prefixes of the new one.
                old = plain(state[begin:old_end]), (e - s) - (old_end - begin), max(b + more, begin + more, s) - s
            last, n = self.last_tokens(piece, known, old)
            computed += n
            self._add(out, last)
            # A piece end that is an old one, behind the edit: the same text follows, so the same pieces do.
            if old_end >= b and old_end <= len(state) and e >= a + len(inserted.encode()) and (old_end == len(state) or (old_end > 0 and state[old_end - 1] < 0)):
                out.extend(state[old_end:])
                break
        return new, out, computed


class Vocabulary:
    """Tokens and pattern, sent to the workers once; its size is that of the vocabulary file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        self._sent, self._key = spark.sparkContext.broadcast(tokens), (hashlib.sha256(b"\n".join(map(base64.b64encode, tokens))).hexdigest(), pattern)

    def codec(self) -> Codec:
        """In a worker: made once per process, and kept from task to task."""
        if self._key not in _CODECS:
            _CODECS[self._key] = Codec(self._sent.value, self._key[1])
        return _CODECS[self._key]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    """A list column from arrays of one kind."""
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = array("i")
    for r in rows:
        flat.extend(r)
    offsets = pa.array(ends, pa.int32()) if ends[-1] < 1 << 31 else pa.array(ends, pa.int64())
    values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), kind)
    return (pa.ListArray if offsets.type == pa.int32() else pa.LargeListArray).from_arrays(offsets, values)


#: Rows of an output batch: texts and tokens of so many rows are held at once.
ROWS = 256


def _mapped(df: DataFrame, reads: list[str], added: str, work) -> DataFrame:
    """df with more columns, which `work` makes of the columns `reads`, a few rows at a time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {added}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                made = work(*(some.column(some.schema.get_field_index(c)) for c in reads))
                yield pa.RecordBatch.from_arrays([*some.columns, *made.values()], [*some.schema.names, *made])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with `tokens`, the ids of each whole text."""

    def work(texts):
        c = vocabulary.codec()
        return {"tokens": _lists([c.encode(t or "") for t in texts.to_pylist()], pa.int32())}

    return _mapped(set_aside(docs, "tokens"), [text], "tokens array<int>", work)


def decode(encoded: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens") -> DataFrame:
    """A table with ids and `decoded`, the bytes that they stand for; a null list has none."""

    def work(lists):
        known = vocabulary.codec().tokens
        return {"decoded": pa.array([b"".join(map(known.__getitem__, ids or ())) for ids in lists.to_pylist()], pa.binary())}

    return _mapped(set_aside(encoded, "decoded"), [tokens], "decoded binary", work)


def _packed(state: list[int]) -> bytes:
    return np.array(state, "<i4").tobytes()


def prefix_table(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with `state`: the last token of each byte prefix as four bytes, piece ends marked."""

    def work(texts):
        c = vocabulary.codec()
        return {"state": pa.array([_packed(c.table(t or "")) for t in texts.to_pylist()], pa.binary())}

    return _mapped(set_aside(docs, "state"), [text], "state binary", work)


def state_tokens(states: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A prefix table with `tokens`, read off from the last entry back."""

    def work(packed):
        c = vocabulary.codec()
        return {"tokens": _lists([c.walk([x if x >= 0 else ~x for x in np.frombuffer(s, "<i4").tolist()]) for s in packed.to_pylist()], pa.int32())}

    return _mapped(set_aside(states, "tokens"), ["state"], "tokens array<int>", work)


def re_encode(states: DataFrame, edits: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """Texts and states after edits, with `computed`, the entries that had to be made anew; states without an edit go through as they are.

    states: key, text, state. edits: key, at and removed (code points; null: the text's end, and none), inserted (null:
    empty). An append is an edit at the end. A key in edits twice gives a row for each of its edits.
    """
    both = states.select(key, "text", "state").join(edits.select(key, "at", "removed", "inserted", F.lit(True).alias("is_edited")).hint("merge"), key, "left")

    def work(texts, packed, ats, gone, put, is_edited):
        c, out = vocabulary.codec(), ([], [], [])
        for t, s, at, n, x, e in zip(*(v.to_pylist() for v in (texts, packed, ats, gone, put, is_edited)), strict=True):
            t = t or ""
            row = c.edited(t, np.frombuffer(s, "<i4").tolist(), len(t) if at is None else at, n or 0, x or "") if e else (t, None, 0)
            for column, value in zip(out, (row[0], s if row[1] is None else _packed(row[1]), row[2]), strict=True):
                column.append(value)
        return {"new_text": pa.array(out[0], pa.string()), "new_state": pa.array(out[1], pa.binary()), "computed": pa.array(out[2], pa.int64())}

    made = _mapped(both, ["text", "state", "at", "removed", "inserted", "is_edited"], "new_text string, new_state binary, computed long", work)
    return made.select(key, F.col("new_text").alias("text"), F.col("new_state").alias("state"), "computed")


def round_trip_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: its ids, and the bytes that they decode to."""
    both = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    ids = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
