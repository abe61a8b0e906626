"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding.  A text is cut by the tokenizer's pattern; every match is encoded by
itself.  For a byte string w let last(i) be the final token of the encoding of
w[:i].  A token t that ends at i is last(i) exactly if (last(i-|t|), t) is a
stable pair, that is, if encoding the two tokens' joined bytes gives the same
two tokens back.  So the only things a left-to-right reader has to remember are
the open starts: positions s such that w[s:i] is a proper prefix of some token,
with the token that ended there and the tokens not yet emitted.  That memory,
made relative to i, is a state; transitions are computed from the merges the
first time they are met and kept.  Tokens that all open starts agree on cannot
change any more and are emitted, so output lags input by a bounded lookahead.

Decoding streams: token bytes go through an incremental UTF-8 state machine, so
a character may be split over tokens or chunks.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleaner.llm.common import give_back, small_batches, text_of, worker_cache

MAX_STATES, MAX_SIMULATED, MAX_PAIRS = 30_000, 300_000, 400_000  # of a worker's caches: memory against time
LOCKSTEP_BYTES = 96
BATCH_BYTES = 1 << 20
DECODE_CHUNK = 65_536

# Latin text can be cut by the standard library's faster engine: over these
# characters the classes written out are exactly the pattern's.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NOT_PLAIN = re.compile(rf"[^\t\n\r\x20-\x7e{_LATIN}\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2026\u20ac]")
# the pattern whose classes may be written out over plain texts (a fixed value)
PLAIN_FORM_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """Rows of ``table`` are states, columns the 256 bytes and the end of a piece.

    An entry numbers a transition (0: not met yet); ``target`` has its next
    state, ``first``/``count`` the slice of ``output`` that it emits.  Many
    pieces advance in step, one numpy gather for each position.

    Common states are met first.  Once ``max_states`` are determinised the
    table is frozen, and a piece that would leave it is simulated without
    making states (the same open starts, walked for this piece alone).
    """

    END = 256
    DEAD = 1  # the state, and the transition to it, of pieces that left the frozen table

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_simulated: int = MAX_SIMULATED, max_pairs: int = MAX_PAIRS):
        self.ranks = ranks
        self.max_states, self.max_simulated, self.max_pairs = max_states, max_simulated, max_pairs
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.proper_prefixes = {token[:k] for token in ranks for k in range(1, len(token))}
        self.never = max(ranks.values(), default=0) + 1
        self.edges: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table = np.zeros((1024, 257), np.int32)
        self.target = np.zeros(1024, np.int32)
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.output: list[int] = []
        self.simulated: dict[bytes, list[int]] = {}
        # (open bytes since the start, last token before it or -1, tokens not yet emitted up to it)
        self._state(((b"", -1, ()),))
        self._state(())
        self.table[self.DEAD] = self.DEAD
        self.target[self.DEAD] = self.DEAD
        self.transitions = 2

    def _state(self, key: tuple) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((min(len(self.table), 4096), 257), np.int32)])
        return found

    def merge(self, piece: bytes) -> list[bytes]:
        """Encoding by definition: join the leftmost pair of lowest rank until none is left."""
        return self._merge(piece, None)

    def _merge(self, piece: bytes, trace: tuple[list[bytes], list[bytes]] | None) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            if trace is not None:
                for spine, edge in zip(trace, (parts[0], parts[-1]), strict=True):
                    if not spine or spine[-1] != edge:
                        spine.append(edge)
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, token: bytes) -> tuple[list[bytes], list[bytes]]:
        """The leftmost and the rightmost part at each time while the token is built up."""
        known = self.edges.get(token)
        if known is None:
            known = self.edges[token] = ([], [])
            if self._merge(token, known) != [token]:
                known[0].append(b"")  # never an encoding of itself
        return known

    def _fits(self, before: int, token: int) -> bool:
        """Whether no merge ever crosses the border between the two tokens' bytes."""
        pair = (before, token)
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= self.max_pairs:
                self.stable.clear()
            known = self.stable[pair] = self._border_holds(before, token)
        return known

    def _border_holds(self, before: int, token: int) -> bool:
        right = self._edges(self.token_bytes[token])[0]
        if right[-1] == b"":
            return False
        if before < 0:
            return True
        left = self._edges(self.token_bytes[before])[1]
        ranks, never, i, j = self.ranks, self.never, 0, 0
        while True:
            grown_left = ranks[left[i + 1]] if i + 1 < len(left) else never
            grown_right = ranks[right[j + 1]] if j + 1 < len(right) else never
            across = ranks.get(left[i] + right[j], never)
            if across < grown_left and across <= grown_right and across != never:
                return False
            if grown_left == grown_right == never:
                return True
            if grown_left <= grown_right:
                i += 1
            else:
                j += 1

    def _follow(self, state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
        if symbol == self.END:
            return 0, self.states[state][-1][2]
        letter = bytes((symbol,))
        still_open, ended = [], None
        for since, last, pending in self.states[state]:
            since = since + letter
            token = self.ranks.get(since)
            if ended is None and token is not None and self._fits(last, token):
                ended = (b"", token, (*pending, token))
            if since in self.proper_prefixes:
                still_open.append((since, last, pending))
        if ended is None:
            raise ValueError(f"the vocabulary has no encoding at byte {symbol}")
        paths = [*still_open, ended]
        agreed, shortest = 0, min(len(p[2]) for p in paths)
        while agreed < shortest and len({p[2][agreed] for p in paths}) == 1:
            agreed += 1
        key = tuple((since, last, pending[agreed:]) for since, last, pending in paths)
        return self._state(key), ended[2][:agreed]

    def _determinise(self, state: int, symbol: int) -> None:
        target, emitted = self._follow(state, symbol)
        at = self.transitions
        if at >= len(self.target):
            self.target, self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.target, self.first, self.count))
        self.target[at], self.first[at], self.count[at] = target, len(self.output), len(emitted)
        self.output.extend(emitted)
        self.table[state, symbol] = at
        self.transitions += 1

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        met = self.table[state, symbol]
        missing = np.flatnonzero(met == 0)
        if len(missing) and len(self.states) >= self.max_states:
            met[missing] = self.DEAD
        elif len(missing):
            for pair in np.unique(state[missing].astype(np.int64) * 257 + symbol[missing]).tolist():
                self._determinise(*divmod(pair, 257))
            met[missing] = self.table[state[missing], symbol[missing]]
        return met

    def run(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the pieces that ``data`` (uint8) is cut into.

        Returns all ids in order, and for each piece the number of ids up to its end.
        """
        pieces = len(lengths)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        slots = starts + np.arange(pieces)  # each piece has one more slot, for its end
        met = np.zeros(len(data) + pieces, np.int32)
        short = np.flatnonzero(lengths <= LOCKSTEP_BYTES)
        order = short[np.argsort(-lengths[short], kind="stable")]
        at, size, slot = starts[order], lengths[order], slots[order]
        state = np.zeros(len(order), np.int32)
        reach = np.searchsorted(-size, -np.arange(0, (size[0] if len(size) else -1) + 2), side="right")
        for k in range(len(reach) - 1):
            here, further = reach[k], reach[k + 1]
            symbol = np.full(here, self.END, np.int64)
            symbol[:further] = data[at[:further] + k]
            step = self._step(state[:here], symbol)
            met[slot[:here] + k] = step
            state = self.target[step[:further]]
        left = np.zeros(pieces, bool)
        left[lengths > LOCKSTEP_BYTES] = True
        left[order] = met[slot + size] == self.DEAD
        left = np.flatnonzero(left)
        whole = lengths[left] + 1  # what these pieces emitted before they left does not count
        slot_of = np.repeat(slots[left] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
        met[slot_of] = self.DEAD
        counts = self.count[met]
        ends = slots + lengths
        walked, begins = [], []
        for begin, length in zip(starts[left].tolist(), lengths[left].tolist(), strict=True):
            begins.append(len(self.output) + len(walked))
            walked.extend(self.simulate(data[begin : begin + length].tobytes()))
        begins = np.array(begins, np.int64)
        found = np.diff(begins, append=len(self.output) + len(walked))
        counts[ends[left]] = found
        emits = np.flatnonzero(counts)  # most slots emit nothing, so only these are widened
        first, counts = self.first[met[emits]], counts[emits].astype(np.int64)
        first[np.searchsorted(emits, ends[left][found > 0])] = begins[found > 0]
        known = np.concatenate([[0], np.cumsum(counts)])
        source = np.arange(known[-1]) + np.repeat(first - known[:-1], counts)
        return np.array(self.output + walked, np.int64)[source], known[np.searchsorted(emits, ends, side="right")]

    def simulate(self, piece: bytes) -> list[int]:
        """The same walk over open starts, for one piece, with no states made."""
        known = self.simulated.get(piece)
        if known is not None:
            return known
        ranks, prefixes, fits, stable = self.ranks, self.proper_prefixes, self._fits, self.stable
        last, begin, still_open = [-1], [0], [0]
        for i in range(1, len(piece) + 1):
            ended, further = None, []
            for s in still_open:
                since = piece[s:i]
                if ended is None:
                    token = ranks.get(since)
                    if token is not None:
                        holds = stable.get((last[s], token))
                        if fits(last[s], token) if holds is None else holds:
                            ended = (token, s)
                if since in prefixes:
                    further.append(s)
            if ended is None:
                raise ValueError(f"the vocabulary has no encoding at byte {piece[i - 1]}")
            last.append(ended[0])
            begin.append(ended[1])
            further.append(i)
            still_open = further
        ids, i = [], len(piece)
        while i:
            ids.append(last[i])
            i = begin[i]
        ids.reverse()
        if len(piece) <= LOCKSTEP_BYTES:
            if len(self.simulated) >= self.max_simulated:
                self.simulated.clear()
            self.simulated[piece] = ids
        return ids


class Codec:
    """Cuts texts by the pattern, runs the transducer over all pieces at once, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, caches: tuple[int, int, int] = (MAX_STATES, MAX_SIMULATED, MAX_PAIRS)):
        self.transducer = Transducer(ranks, *caches)
        self.cut_any = regex.compile(pattern).findall
        plain = pattern.replace(r"\p{L}", _LATIN).replace(r"\p{N}", "0-9")
        # outside a character class the letters need brackets of their own
        plain = re.sub(rf"(?<!\\s)(?<!\[\^)({re.escape(_LATIN)}|0-9)\+", r"[\1]+", plain)
        self.cut_plain = re.compile(plain).findall if pattern == PLAIN_FORM_KNOWN else self.cut_any
        tokens = self.transducer.token_bytes
        size = max(tokens, default=-1) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if size else self.lengths
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int64) of each text."""
        sizes, marks, data = [], [], []
        for text in texts:
            cut = self.cut_any if _NOT_PLAIN.search(text) else self.cut_plain
            size = np.fromiter(map(len, cut(text)), np.int64)
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            if len(raw) != len(text):  # lengths in characters, wanted in bytes
                character = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                size = np.diff(character[np.concatenate([[0], np.cumsum(size)])])
            data.append(raw)
            sizes.append(size)
            marks.append(len(size))
        lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ids, ends = self.transducer.run(np.concatenate(data) if data else np.zeros(0, np.uint8), lengths)
        stops = np.concatenate([[0], ends])[np.cumsum(marks)] if len(ends) else np.zeros(len(texts), np.int64)
        return np.split(ids, stops[:-1]) if len(texts) else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def token_text(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, joined: a gather from one table of all tokens."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.blob[source].tobytes()

    def decode_stream(self, chunks: Iterable[np.ndarray], errors: str = "strict") -> Iterator[str]:
        """Text as it becomes known from chunks of ids; a character split over chunks waits in the state machine."""
        machine = codecs.getincrementaldecoder("utf-8")(errors=errors)
        for chunk in chunks:
            yield machine.decode(self.token_text(np.asarray(chunk, np.int64)))
        yield machine.decode(b"", final=True)


def codec_for(raw: bytes, pattern: str, caches: tuple[int, int, int] = (MAX_STATES, MAX_SIMULATED, MAX_PAIRS)) -> Codec:
    """One codec for each worker process, vocabulary and size of caches."""
    held = worker_cache("bpe")
    key = (hashlib.sha256(raw + pattern.encode()).hexdigest(), caches)
    if key not in held:
        held[key] = Codec(parse_ranks(raw), pattern, caches)
    return held[key]


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BATCH_BYTES together, so that memory does not follow the batch."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_rows(codec: Codec, batch: pa.RecordBatch, keep_ids: bool) -> pa.RecordBatch:
    """The results for a batch of ids and texts; what it took besides is free when this returns."""
    counts, all_ids, ids_sha, text_sha = [], [np.zeros(0, np.int64)], [], []
    for texts in slices(batch.column(1).to_pylist()):
        for ids in codec.encode_batch(texts):
            decoded = hashlib.sha256()
            parts = (ids[i : i + DECODE_CHUNK] for i in range(0, len(ids), DECODE_CHUNK))
            for part in codec.decode_stream(parts):
                decoded.update(part.encode("utf-8"))
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(decoded.hexdigest())
            if keep_ids:
                all_ids.append(ids)
    columns = [batch.column(0), pa.array(counts, pa.int64())]
    if keep_ids:  # numbers throughout: a list of Python's takes nine times the memory
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids))))
    columns += [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
    names = ["id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
    caches: tuple[int, int, int] = (MAX_STATES, MAX_SIMULATED, MAX_PAIRS),
) -> DataFrame:
    """Encode every whole text, decode the ids again, and report both.

    Returns ``id_col, n_tokens, [ids array<bigint>,] ids_sha256, decoded_sha256``,
    one row for each input row in any order.  A null text is the empty text: no
    tokens and the digests of nothing.  Repeated rows give repeated results; a
    null id stays null; other columns are not read, whatever their names.  The
    vocabulary is read on the driver and broadcast: a file of fixed size that
    does not grow with the data.  ``caches`` bounds a worker's states, simulated
    pieces and known pairs; smaller ones take less memory and more time.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern, caches)
        for batch in batches:
            yield encode_rows(codec, batch, keep_ids)
            give_back()

    schema = f"id {kind}, n_tokens bigint, {'ids array<bigint>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from arrays of ids; invalid UTF-8 in a made-up sequence becomes U+FFFD."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(raw)
    source = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<bigint>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, ".+")
        for batch in batches:
            texts = ["".join(codec.decode_stream([ids or []], errors="replace")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
