"""Token counts by compiled finite-state transducers, for byte-level BPE vocabularies (tokenizers .json).

Two deterministic transducers run one after the other:

* The splitter reads character classes and emits pre-token starts. It has twelve states, so a chunk of
  text is a map from twelve entry states to twelve exit states. All chunks of a batch run in step, their
  maps compose by a parallel prefix scan, and a second run from the known entry states emits the starts.
* The merger reads the bytes of one pre-token. Each transition is annotated with the number of tokens it
  adds to (or takes from) the count so far; states are compiled when first reached and kept. A state
  knows the longest suffix that can still begin a longer token, with the last token and relative count
  at each place in it. A byte sequence's last token is the only vocabulary suffix that stays apart from
  the last token before it, which a merge of the two decides once for each pair. A text is cut into chunks
  of SPAN characters. What a chunk does to the merger is a map from its entry state to its exit state and the tokens
  it adds; from the first pre-token that starts in it on, that is the same for all entries, so the map is
  kept as the head before it, a number and an exit. Maps compose, and a text's count is its composed map's number. (A pre-token
  that was run before from the start is looked up; that is a memory of runs, not another way to count.)

Defined results: NULL counts as the empty text, with 0 tokens; the strings of added special tokens are
one token each, as the library has it by default; no begin or end tokens, truncation or padding.
Repeated rows and extra columns pass; other columns are not touched; a very long text is many chunks.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import gathered, read

LIMIT = 512
#: Characters of a chunk of the splitter, and of the merger.
CHUNK, SPAN = 256, 4096
#: Compiled states and cached pre-tokens of a worker; beyond that they are dropped and compiled anew.
MOST_STATES, MOST_WORDS = 400_000, 1_500_000

LETTER, SINGLE, R, V, E, L, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, STOP = range(12)
FRESH, IN_LETTERS, IN_NUMBER, IN_OTHER, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
STATES = 12
#: Emissions: a pre-token starts here; one starts at the character before.
HERE, BEFORE = 1, 2


def character_classes() -> np.ndarray:
    """Class of each code point, by its Unicode category; contraction letters and the apostrophe apart."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for point in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[point] = WHITE
    for chars, kind in (("stmd", SINGLE), ("r", R), ("v", V), ("e", E), ("l", L), (" ", SPACE), ("'", APOSTROPHE)):
        table[[ord(c) for c in chars]] = kind
    return table


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, indexed by class * STATES + state."""
    nxt, emit = np.zeros(12 * STATES, np.uint8), np.zeros(12 * STATES, np.uint8)
    letters = {LETTER, SINGLE, R, V, E, L}

    def settled(kind: int, state: int) -> tuple[int, int]:
        """From a state that waits for nothing."""
        if kind in letters:
            return IN_LETTERS, 0 if state == IN_LETTERS else HERE
        if kind == NUMBER:
            return IN_NUMBER, 0 if state == IN_NUMBER else HERE
        if kind == OTHER:
            return IN_OTHER, 0 if state == IN_OTHER else HERE
        if kind == APOSTROPHE:
            return (IN_OTHER, 0) if state == IN_OTHER else (QUOTE, HERE)
        return {SPACE: (ONE_SPACE, HERE), WHITE: (ONE_WHITE, HERE), STOP: (FRESH, HERE)}[kind]

    for kind in range(12):
        for state in range(STATES):
            white, to = kind in (SPACE, WHITE), settled(kind, FRESH)
            joined = IN_OTHER if kind == APOSTROPHE else to[0]
            if state <= IN_OTHER:
                step = settled(kind, state)
            elif state <= MORE_WHITE and white:
                step = (MORE_SPACE if kind == SPACE else MORE_WHITE), 0
            elif state <= MORE_WHITE and kind == STOP:
                step = FRESH, HERE
            elif state == ONE_SPACE:
                step = joined, 0
            elif state == MORE_SPACE:
                step = joined, BEFORE
            elif state == ONE_WHITE:
                step = to
            elif state == MORE_WHITE:
                step = to[0], HERE | BEFORE
            elif state == QUOTE:
                if kind == SINGLE:
                    step = FRESH, 0
                elif kind in (R, V, L):
                    step = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
                else:
                    step = settled(kind, IN_OTHER)
            elif kind == (L if state == QUOTE_L else E):
                step = FRESH, 0
            else:
                there, out = settled(kind, IN_LETTERS)
                step = there, out | BEFORE
            nxt[kind * STATES + state], emit[kind * STATES + state] = step
    return nxt, emit


def starts_of(classes: np.ndarray, nxt: np.ndarray, emit: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where pre-tokens start, in a stream that begins in FRESH."""
    n = len(classes)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, STOP, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(lanes, chunk).T) * np.uint8(STATES)
    # Maps of the chunks: all entry states at once; where they have met, one is enough.
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, 1)
    apart = np.arange(lanes)
    done = 0
    while len(apart) and done < chunk:
        part = maps[:, apart]
        upto = min(chunk, done + 16)
        for t in range(done, upto):
            part = nxt[part + steps[t, apart][None, :]]
        maps[:, apart] = part
        met = (part == part[:1]).all(0)
        if met.any():
            one, who = part[0, met], apart[met]
            rest = steps[upto:, who]
            for row in rest:
                one = nxt[one + row]
            maps[:, who] = one[None, :]
        apart, done = apart[~met], upto
    # Prefix scan: after it, maps[:, i] leads from the start of the stream to the end of chunk i.
    shift = 1
    while shift < lanes:
        maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift], 0)
        shift *= 2
    state = np.concatenate([np.array([FRESH], np.uint8), maps[FRESH, :-1]])
    out = np.empty((chunk, lanes), np.uint8)
    for t in range(chunk):
        at = state + steps[t]
        out[t] = emit[at]
        state = nxt[at]
    flat = out.T.reshape(-1)[:n]
    here = (flat & HERE).astype(bool)
    here[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(here)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Span(NamedTuple):
    """What a chunk does to the merger: `head` is read from the entry state; then `added` tokens come and the state is `exit`.
    exit None: no pre-token starts in the chunk, so its state follows from the entry and the head."""

    head: str
    added: int
    exit: tuple | None


class Merger:
    """The lazily compiled transducer over bytes of a pre-token."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[bytes, bytes]]) -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # Bytes have the numbers 0 to 255; a merged token has 256 and its merge's rank, and its two halves.
        self.number = {bytes((b,)): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for i, (left, right) in enumerate(merges):
            self.number.setdefault(left + right, 256 + i)
            self.halves.append((self.number[left], self.number[right]))
            self.joined[self.number[left], self.number[right]] = 256 + i
        known = set(vocabulary)
        self.whole: dict[bytes, bool] = {t: len(t) == 1 for t in known}
        self.unsure = {t for t in known if len(t) > 1}
        self.heads = {t[:i] for t in known for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def is_token(self, raw: bytes) -> bool:
        """In the vocabulary, and what its own bytes merge to."""
        if raw in self.unsure:
            self.unsure.discard(raw)
            self.whole[raw] = self.merged(raw) == [raw]
        return self.whole.get(raw, False)

    def reset(self) -> None:
        self.ids: dict = {}
        self.keys: list = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.words: dict[str, int] = {}
        self.start = self.state((b"", ((None, 0),)))

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return self.ids[key]

    def merged(self, raw: bytes) -> list[bytes]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays_apart(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self.no_merge_between(self.number[left], self.number[right])
        return found

    def no_merge_between(self, a: int, b: int) -> bool:
        """Undo the last merges on either side of the seam, latest first; a merge across it must never come before the next of them."""
        bound = len(self.halves)
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                return False
            for side in (0, 1) if a > b else (1, 0):
                if side == 0 and a > 255:
                    bound, a = a, self.halves[a][1]
                    break
                if side == 1 and b > 255:
                    bound, b = b + 1, self.halves[b][0]
                    break
            else:
                return True

    def compile(self, at: int, byte: int) -> tuple[int, int]:
        suffix, trail = self.keys[at]
        read_ = suffix + bytes((byte,))
        m = len(read_)
        for p in range(m):  # longest first
            token = read_[p:]
            if self.is_token(token) and self.stays_apart(trail[p][0], token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        added = trail[p][1] + 1
        keep = next((m - p for p in range(m) if read_[p:] in self.heads), 0)
        full = (*trail, (token, added))
        key = (read_[m - keep :], tuple((t, c - added) for t, c in full[m - keep :]))
        step = (self.state(key), added)
        self.steps[at][byte] = step
        return step

    def count(self, word: str) -> int:
        if len(self.keys) > MOST_STATES or len(self.words) > MOST_WORDS:
            self.reset()
        return self.run(self.start, word)[1]

    def composed(self, a: Span, b: Span) -> Span:
        """a, then b. States go by their keys, which outlast a reset."""
        if a.exit is None:
            return Span(a.head + b.head, b.added, b.exit)
        at, n = self.run(self.state(a.exit), b.head)
        return Span(a.head, a.added + n + b.added, self.keys[at] if b.exit is None else b.exit)

    def whole_text(self, spans: list[Span]) -> int:
        """Tokens of a text from its chunks' maps, composed pair by pair."""
        while len(spans) > 1:
            spans = [self.composed(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        return spans[0].added

    def run(self, at: int, word: str) -> tuple[int, int]:
        """State and tokens added after a word's bytes."""
        total, steps = 0, self.steps
        for byte in word.encode("utf-8", "surrogatepass"):
            step = steps[at].get(byte)
            at, added = step if step is not None else self.compile(at, byte)
            total += added
        return at, total

    def counts(self, words: list[str]) -> list[int]:
        known = self.words
        out = list(map(known.get, words))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    w = words[i]
                    n = self.words.get(w)
                    if n is None:
                        n = self.count(w)
                        self.words[w] = n
                    out[i] = n
        return out


class Counter:
    """Both transducers of one tokenizer file."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is compiled")
        if pre.get("use_regex") is False or spec["model"].get("ignore_merges") or any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word")):
            raise ValueError("a tokenizer without the splitter, with ignored merges, or with added tokens that strip or stand alone is not compiled")
        letters = byte_letters()
        special = [t["content"] for t in spec.get("added_tokens", [])]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = Merger([as_bytes(t) for t in spec["model"]["vocab"] if t not in special], [(as_bytes(a), as_bytes(b)) for a, b in merges])
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.classes = character_classes()
        self.nxt, self.emit = splitter()

    def token_counts(self, texts: list[str], span: int = SPAN) -> np.ndarray:
        """Tokens of each text. The texts' pieces form one stream, with a stop after each."""
        n = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            n[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        stream = " ".join(pieces) + " "
        points = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        classes[stops] = STOP
        starts = starts_of(classes, self.nxt, self.emit)
        ends = np.append(starts[1:], len(points))
        real = classes[starts] != STOP
        starts, ends = starts[real], ends[real]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = stops - sizes
        chunks = np.maximum(1, -(-sizes // span))
        base = np.cumsum(chunks) - chunks
        piece = np.searchsorted(stops, starts)
        first, last = base[piece] + (starts - begins[piece]) // span, base[piece] + (ends - 1 - begins[piece]) // span
        inside = first == last
        words = [stream[a:b] for a, b in zip(starts[inside].tolist(), ends[inside].tolist(), strict=True)]
        total = int(chunks.sum())
        added = np.bincount(first[inside], np.array(self.merger.counts(words), np.int64), total).astype(np.int64)
        out = np.bincount(np.asarray(owner, np.int64), np.add.reduceat(added, base), len(texts)).astype(np.int64)
        many = np.flatnonzero(chunks > 1)
        if len(many):
            fresh = self.merger.keys[self.merger.start]
            begun = np.bincount(first, minlength=total) > 0
            maps = [Span("", int(a), fresh if b else None) for a, b in zip(added.tolist(), begun.tolist(), strict=True)] if len(many) else []
            for a, b, p, i, j in zip(starts[~inside].tolist(), ends[~inside].tolist(), piece[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist(), strict=True):
                borders = [a, *[int(begins[p]) + int(k - base[p]) * span for k in range(i + 1, j + 1)], b]
                at, tokens = self.merger.run(self.merger.start, stream[a : borders[1]])
                maps[i] = Span(maps[i].head, maps[i].added + tokens, self.merger.keys[at])
                for k in range(i + 1, j + 1):
                    maps[k] = maps[k]._replace(head=stream[borders[k - i] : borders[k - i + 1]])
            for p in many.tolist():
                here = maps[base[p] : base[p] + chunks[p]]
                out[owner[p]] += self.merger.whole_text(here) - int(added[base[p] : base[p] + chunks[p]].sum())
        return n + out


_compiled: dict[str, Counter] = {}


def compiled(raw: bytes) -> Counter:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Counter(raw)
    return _compiled[key]


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row. The tokenizer file (a few MB) is read here and sent to the executors."""
    with open(tokenizer, "rb") as f:
        raw = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(sent.value)
        for part in gathered(batches, text):
            texts = [t or "" for t in part.column(text).to_pylist()]
            tokens = counter.token_counts(texts)
            sizes = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), sizes, pa.array(tokens), pa.array(tokens > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
