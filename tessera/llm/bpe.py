"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that a pyahocorasick trie of the vocabulary gives the longest token at a
place. A token may follow another only if the merges of their joined bytes give exactly that pair (memoised). The encoder takes
the longest token that may follow the last one, falls back to shorter prefixes, and on a dead end steps back; places
found dead are marked and never tried again, so each place is left at most once and the time is linear in the bytes. The
result equals that of the merges in order of rank.

New short pieces of some documents are encoded together: `encode_pieces` takes the steps of `encode_piece` for all of them at
once, on arrays, with the trie as a table. Long pieces are encoded one by one.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_bytes

#: Bytes that a task's memo of pieces may take, about, and entries of its memo of pairs; a full memo starts anew.
MEMO_BYTES, MEMO_PAIRS = 72 << 20, 150_000
#: Pieces up to this many characters are memoised; longer ones are encoded each time.
MEMO_PIECE = 64
#: Pieces whose new ones are looked for together, about, and new ones that take their steps together; both bound a task's memory.
TOGETHER, STEPPED = 1 << 18, 1 << 16


class Memo(dict):
    """Piece -> its ids as bytes of 32-bit numbers; computes what it doesn't hold.

    Two generations of MEMO_BYTES / 2 each: at a full one the older goes, but for what is used again.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.taken, self.older = make, 0, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            value = array("i", self.make(piece.encode())).tobytes()
        if len(piece) <= MEMO_PIECE:
            self.hold(piece, value)
        return value

    def hold(self, piece: str, value: bytes) -> None:
        self.taken += 4 * len(piece) + len(value) + 200  # both objects and their place in the table
        if 2 * self.taken > MEMO_BYTES:
            self.older = dict(self)
            self.clear()
            self.taken = 0
        self[piece] = value

    def missing(self, pieces: set[str]) -> list[str]:
        """Of the pieces those that could be held and aren't."""
        return [p for p in pieces - self.keys() if p not in self.older and len(p) <= MEMO_PIECE]


class BytePairs:
    """Encoder and decoder for ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.most = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.trie = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.trie.add_word(t.decode("latin-1"), i)
        self._ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self._size = {i: len(t) for t, i in ranks.items()}
        self._reached: set[int] = set()
        self._pairs: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self.pieces = Memo(self.encode_piece)
        self._tables()

    def _tables(self) -> None:
        """The trie and the memos of `encode_pieces`, as arrays. An edge (node << 8 | byte) leads to the node of the edge's number, from 1; 0 is the root. Edges are in order."""
        tokens = sorted(self.ranks)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter(map(self.ranks.__getitem__, tokens), np.int64, len(tokens))
        letters = np.frombuffer(b"".join(t.ljust(self.most, b"\0") for t in tokens), np.uint8).reshape(len(tokens), self.most)
        node, nodes = np.zeros(len(tokens), np.int64), 1
        edges, ends = [], [np.full(1, -1)]
        for depth in range(self.most):
            longer = length > depth
            ids, letters, length = ids[longer], letters[longer], length[longer]
            edge = node[longer] << 8 | letters[:, depth]
            first = np.diff(edge, prepend=-1) > 0  # tokens are in order, so edges are
            node = nodes - 1 + np.cumsum(first)
            end = ends[-1][(edge[first] >> 8) - (nodes - len(ends[-1]))]  # the longest token on the way to a node
            ending = length == depth + 1
            end[node[ending] - nodes] = ids[ending]
            nodes += len(end)
            edges.append(edge[first])
            ends.append(end)
        self._edges, self._end = np.concatenate(edges), np.concatenate(ends).astype(np.int32)
        most = max(self.tokens) + 1
        self._sizes = np.zeros(most, np.int64)
        self._sizes[list(self._size)] = list(self._size.values())
        self._best, self._less = np.full(most, -2, np.int32), np.full(most, -2, np.int32)
        self._follow_keys, self._follow_tokens = np.full(1, -1, np.int64), np.full(1, -1, np.int32)

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The merges by rank on a short string, down to `least` tokens: of all adjacent pairs the lowest rank merges first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens of a token's last merge; itself twice for a single byte, (-1, -1) where the merges don't give the token."""
        found = self._parts.get(token)
        if found is None:
            data = self.tokens[token]
            last = self.merged(data, 2) if len(data) > 1 else [token, token]
            whole = len(last) == 2 and (len(data) == 1 or self.ranks.get(self.tokens[last[0]] + self.tokens[last[1]]) == token)
            found = self._parts[token] = (last[0], last[1]) if whole else (-1, -1)
        return found

    def reached(self, token: int) -> bool:
        """Whether the merges of a token's own bytes give that token."""
        if token in self._reached:
            return True
        if self.parts(token)[0] < 0:
            return False
        self._reached.add(token)
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes give exactly these two. A memo holds the answers.

        Merges across the border are looked for backwards: the token that was merged last is undone, down to single bytes. At each step the
        two tokens at the border would merge if that comes before the merges that took them further: before the left one's, or not
        after the right one's, as equal ranks go from left to right.
        """
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def follows(self, a: int, b: int) -> int:
        """Of b and its shorter ones the longest token that may follow a (-1: nothing before, so b); -1 if none."""
        while a >= 0 and b >= 0 and not self._apart(a, b):
            b = self.shorter(b)
        return b

    def _apart(self, a: int, b: int) -> bool:
        rank, tokens, parts = self.ranks.get, self.tokens, self.parts
        left_until = right_until = 1 << 60
        left, right = tokens[a], tokens[b]
        while True:
            r = rank(left + right)
            if r is not None and r < left_until and r <= right_until:
                return False
            if len(left) > 1 and (a > b or len(right) == 1):
                left_until, a = a, parts(a)[1]
                left = tokens[a]
            elif len(right) > 1:
                right_until, b = b, parts(b)[0]
                right = tokens[b]
            else:
                return True

    def longest(self, text: str, at: int, most: int) -> int:
        """Id of the longest reachable token of at most `most` bytes at a place of Latin-1 text; -1 if none."""
        part, ids, reached = text[at : at + most], self._ids, self._reached
        n = self.trie.longest_prefix(part)
        while n:
            i = ids.get(part[:n], -1)
            if i >= 0 and (i in reached or self.reached(i)):
                return i
            n -= 1
        return -1

    def shorter(self, token: int) -> int:
        """Id of the longest reachable proper prefix of a token; -1 if none."""
        if token not in self._shorter:
            text = self.tokens[token].decode("latin-1")
            self._shorter[token] = self.longest(text, 0, len(text) - 1) if len(text) > 1 else -1
        return self._shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, as tiktoken has it."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, most, n, size, pairs, longest = data.decode("latin-1"), self.most, len(data), self._size, self._pairs, self.longest
        open_at = bytearray(b"\x01") * (n + 1)
        token = longest(text, 0, most)
        out: list[int] = []
        at = 0
        while at < n:
            end = at + size[token]
            if open_at[end]:
                fits = True
                if out:  # the memo of `compatible`, read in place
                    fits = pairs.get(out[-1] << 32 | token)
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest(text, at, most)
                    continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here: this place is dead, take a shorter token before it
                open_at[at] = 0
                last = out.pop()
                at -= size[last]
                token = self.shorter(last)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces that aren't empty, joined, and how many each has: as `encode_piece` gives them, a step of all pieces at a time."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths + 1) - 1
        starts = stops - lengths
        letters = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16)
        letters[stops] = 256
        open_at, used = np.ones(len(letters), bool), np.zeros(len(letters), bool)
        token_at, before = np.zeros(len(letters), np.int32), np.full(len(letters), -1, np.int64)  # the token tried at a place; where the one before it begins
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        token_at[starts], used[starts] = whole, whole >= 0
        at = starts[whole < 0]
        token = self._longest_at(letters, at)
        while len(at):
            token = self._following(np.where(before[at] < 0, -1, token_at[before[at]]), token)
            dead = token < 0
            end = at + np.where(dead, 0, self._sizes[token])
            taken = ~dead & open_at[end]
            blocked = ~dead & ~taken
            here, there = at[taken], end[taken]
            token_at[here], used[here], before[there] = token[taken], True, here
            go = letters[there] < 256
            back = before[at[dead]]  # these places are dead, the token before them gets shorter
            if (back < 0).any():
                raise ValueError("the ranks lack a byte")
            open_at[at[dead]] = used[back] = False
            token = np.concatenate([self._longest_at(letters, there[go]), self._known(self._less, np.concatenate([token_at[back], token[blocked]]), self.shorter)])
            at = np.concatenate([there[go], back, at[blocked]])
        return token_at[used], np.add.reduceat(used, starts, dtype=np.int64)

    def _longest_at(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest reachable token at each place; -1 if none."""
        node, live, deepest = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(live):
            edge = node << 8 | letters[at]
            i = np.searchsorted(self._edges, edge)
            more = (self._edges[np.minimum(i, len(self._edges) - 1)] == edge) & (letters[at] < 256)
            node, live, at = i[more] + 1, live[more], at[more] + 1
            deepest[live] = node
        return self._known(self._best, self._end[deepest], lambda i: i if self.reached(i) else self.shorter(i))

    def _known(self, memo: np.ndarray, tokens: np.ndarray, make) -> np.ndarray:
        """make of each token, -1 for -1; the memo has -2 for what isn't known yet."""
        some = tokens[tokens >= 0]
        for i in np.unique(some[memo[some] == -2]).tolist():
            memo[i] = make(i)
        return np.where(tokens < 0, -1, memo[tokens])

    def _following(self, last: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`follows` of each pair, with a memo of sorted keys."""
        keys = last.astype(np.int64) << 32 | tokens
        i = np.searchsorted(self._follow_keys, keys)
        new = np.unique(keys[self._follow_keys[np.minimum(i, len(self._follow_keys) - 1)] != keys])
        if len(new):
            if len(self._follow_keys) + len(new) > MEMO_PAIRS:
                self._follow_keys, self._follow_tokens, new = np.full(1, -1, np.int64), np.full(1, -1, np.int32), np.unique(keys[tokens >= 0])
            both = np.concatenate([self._follow_keys, new])
            order = np.argsort(both, kind="stable")
            made = np.array([self.follows(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int32)
            self._follow_keys, self._follow_tokens = both[order], np.concatenate([self._follow_tokens, made])[order]
            i = np.searchsorted(self._follow_keys, keys)
        return self._follow_tokens[i]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; each match of the pattern is encoded by itself."""
        return self.arrays([text])[0].tolist()

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New short pieces of many texts, or of a run of a long text's pieces, are encoded together."""
        ids: list[list[bytes]] = [[] for _ in texts]
        runs, taken = [], 0
        for text, parts in zip(texts, ids):
            pieces = self.pattern.findall(text)
            for i in range(0, len(pieces), TOGETHER):
                runs.append((parts, pieces[i : i + TOGETHER]))
                taken += len(runs[-1][1])
                if taken >= TOGETHER:
                    self._encode_runs(runs)
                    runs, taken = [], 0
        self._encode_runs(runs)
        return [np.frombuffer(b"".join(parts), dtype=np.int32) for parts in ids]

    def _encode_runs(self, runs: list[tuple[list[bytes], list[str]]]) -> None:
        """Adds to each list the ids of its pieces."""
        new = self.pieces.missing(set().union(*(pieces for _, pieces in runs)))
        for k in range(0, len(new), STEPPED):
            some = new[k : k + STEPPED]
            ids, sizes = self.encode_pieces([p.encode() for p in some])
            joined, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            for p, i, j in zip(some, [0, *ends], ends):
                self.pieces.hold(p, joined[i:j])
        for parts, pieces in runs:
            parts.append(b"".join(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(lines: bytes, pattern: str) -> BytePairs:
    """The encoder of a rank file's bytes."""
    return BytePairs({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines.splitlines())}, pattern)


def encode_documents(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs -> doc_id, n_tokens, ids array<int>, decoded binary. Null text: empty, no ids. Rows are independent.

    The rank file (about a megabyte whatever the corpus) is read by the driver and broadcast.
    """
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark)
    rank_file = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    with open(rank_file, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = None  # made by the task that needs it and gone with it, so a worker that waits holds no memo
        for batch in batches:
            bpe = bpe or load(lines.value, pattern)
            ids = bpe.arrays([x.decode() for x in text_bytes(batch.column("text"))])
            decoded = [bpe.decode(x.tolist()) for x in ids]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(decoded, pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' rows."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return encoded.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
