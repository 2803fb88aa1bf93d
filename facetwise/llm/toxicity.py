"""Toxicity of texts behind a noisy channel.

A writer's word reaches the text through substitutions (leetspeak, look-alikes, masks), spacing and repetition. Each
suspicious token is a lattice of what its characters may stand for; Viterbi search under a character trigram model finds
the likeliest word. The model is counted over all documents. Documents are scored on their words as they stand and as
restored: words and word beginnings that labelled training rows tie to label 1 combine as a noisy or.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm.common import Scratch, Shared, crc32_mod, texts, words

FOLDS, HELD_OUT = 4, 2
#: At most about so many labelled rows, chosen by a hash of doc_id, fit the scorer.
TRAIN_ROWS = 16_000
#: A sign must be so many standard deviations over the base rate, in so many training rows at least.
MIN_Z, MIN_ROWS = 7.0, 6
PREFIX = 5
PREDICT_FROM = 0.3
#: Longer tokens (addresses, several words in one) are decoded whole and part by part.
LONG_TOKEN = 32
#: Tokens and spaced runs of any length are decoded in pieces of so many characters, which overlap, so that memory is bounded.
PIECE, OVERLAP = 4096, 64
#: Beyond so many states the search goes on with arrays.
FEW = 8
MEMO = 200_000

#: What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "с": "c", "е": "e", "і": "i", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "υ": "u", "ο": "o", "α": "a",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz",
}
SUBSTITUTED, MASKED, SPACED, REPEATED, DROPPED = 2.0, 4.0, 1.0, 0.5, 4.0
SEPARATORS = frozenset(" .-_~'­​‌‍")
_OUTER = " .,;:?\"')[]{}<>&%^~=/\\"
_ONE = r"[a-z0-9@$!|*]"
#: Single characters apart, by separators of any kind, and by one kind of separator only.
_SPACED = re.compile(rf"(?<![^\s])(?:{_ONE}[ .\-_~]){{2,}}{_ONE}(?![^\s.,;:?!])")
_EVEN = re.compile(rf"(?<![^\s]){_ONE}([ .\-_~]){_ONE}(?:\1{_ONE})+(?![^\s.,;:?!])")
_MASKS = frozenset("*#%")
_DOUBLE = re.compile(r"([a-z])\1")
_LONG = re.compile(r"(.)\1{3,}", re.S)
_HIDDEN = re.compile("[" + re.escape("".join(STANDS_FOR) + "".join(sorted(SEPARATORS))) + "]")
_PART = re.compile(r"[^\w" + re.escape("".join(STANDS_FOR)) + "]+")

_SYMBOL = np.zeros(256, np.int32)  # 0: no letter, 1-26: a-z, 27: other letters
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_N = 28
_EVERY = np.arange(_N)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents; at most 28^3 rows come to the driver."""

    def run(batches):
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                c = _SYMBOL[np.frombuffer(b"  " + t + b" ", np.uint8)]
                total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["g", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_N**3)
    out[got.column("g").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(_N, _N, _N)


class Channel:
    """Restores words from what a noisy channel made of them."""

    def __init__(self, counts: np.ndarray):
        counts = counts.copy()
        counts[:, 0, :] = counts[:, 0, :].sum(0, keepdims=True)  # a word's first letter doesn't depend on the word before
        low = counts.sum(0) + 0.5
        low /= low.sum(1, keepdims=True)
        self.cost = -np.log((counts + 20 * low[None]) / (counts.sum(2, keepdims=True) + 20))
        self.__setstate__({"cost": self.cost})

    def __getstate__(self):
        return {"cost": self.cost}

    def __setstate__(self, state):
        self.cost, self.table, self.memo = state["cost"], state["cost"].tolist(), {}
        self.any = np.ascontiguousarray(self.cost[:, :, 1:27])
        self.into = np.ascontiguousarray(self.cost.transpose(2, 0, 1))  # by next letter

    @staticmethod
    def _readings(c: str) -> list[tuple[int, float]]:
        """Letters that c may stand for, and what that costs."""
        if "a" <= c <= "z":
            return [(ord(c) - 96, 0.0)]
        if c in STANDS_FOR:
            some = STANDS_FOR[c]
            return [(ord(x) - 96, SUBSTITUTED if len(some) < 5 else MASKED) for x in some]
        return [(27, 0.0)] if c.isalpha() else []

    def restore(self, token: str, filled: bool = False) -> str:
        """The likeliest word for a lower-case token; letters outside a-z stay as `?`. If filled, every mask is a letter."""
        if (got := self.memo.get((token, filled))) is not None:
            return got
        pieces = range(0, max(1, len(token) - OVERLAP), PIECE - OVERLAP)
        word = self._narrow(token, filled) if len(pieces) == 1 else "".join(self._narrow(token[at : at + PIECE - OVERLAP * (at != pieces[-1])], filled) for at in pieces)
        if len(token) <= 2 * LONG_TOKEN:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token, filled] = word
        return word

    def _stay(self, token: str, at: int, readings: list, filled: bool) -> float | None:
        """What it costs that the character at a place stands for nothing; None if it can't."""
        c = token[at]
        if c in SEPARATORS:
            return SPACED
        if filled and c in _MASKS:
            return None
        if at and c == token[at - 1] and readings:
            return REPEATED
        return DROPPED if not readings or c in "*#%!" else None

    def _narrow(self, token: str, filled: bool = False) -> str:
        """Viterbi search, state by state while there are few; a state is the last two letters."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        table = self.table
        for at, c in enumerate(token):
            if len(best) > FEW:
                return self._decode(token, False, at, best, filled)
            readings, new = self._readings(c), {}
            stay = self._stay(token, at, readings, filled)
            for (a, b), (cost, path) in best.items():
                if stay is not None and ((a, b) not in new or cost + stay < new[a, b][0]):
                    new[a, b] = (cost + stay, path)
                for x, extra in readings:
                    total = cost + table[a][b][x] + extra
                    if (b, x) not in new or total < new[b, x][0]:
                        new[b, x] = (total, path + (chr(96 + x) if x < 27 else "?"))
            best = new
        return min((cost + table[a][b][0], p) for (a, b), (cost, p) in best.items())[1]

    def _decode(self, token: str, apart: bool, first: int = 0, start: dict | None = None, filled: bool = False) -> str:
        """The same search over all states at once. If apart, a separator may also end a word (a blank). start: before character `first`."""
        start = start or {(0, 0): (0.0, "")}
        best = np.full((_N, _N), np.inf)
        for state, (cost, _) in start.items():
            best[state] = cost
        back = []
        for at, c in enumerate(token[first:], first):
            readings = self._readings(c)
            new, came = np.full((_N, _N), np.inf), np.full((_N, _N), -1, np.int16)  # of b, x; came: the a before, or these:
            if (stay := self._stay(token, at, readings, filled)) is not None:  # -1: the state stays
                new = best + stay
            if len(readings) == 26:  # a mask: all letters at once
                total = (best[:, :, None] + self.any).reshape(_N, -1)
                low = total.min(0).reshape(_N, 26) + readings[0][1]
                won = low < new[:, 1:27]
                new[:, 1:27] = np.where(won, low, new[:, 1:27])
                came[:, 1:27] = np.where(won, total.argmin(0).reshape(_N, 26), -1)
                readings = ()
            for x, extra in readings:
                total = best + self.into[x]
                a = total.argmin(0)
                total = total[a, _EVERY] + extra
                won = total < new[:, x]
                new[won, x], came[won, x] = total[won], a[won]
            if apart and c in SEPARATORS:
                total = best + self.into[0] + SPACED
                total[0, 0] = np.inf
                a, b = divmod(int(total.argmin()), _N)
                if total[a, b] < new[0, 0]:
                    new[0, 0], came[0, 0] = total[a, b], -2 - (a * _N + b)  # a word ended in a, b
            back.append(came)
            best = new
        a, b = divmod(int((best + self.into[0]).argmin()), _N)
        out = []
        for came in reversed(back):
            k = int(came[a, b])
            if k <= -2:
                out.append(" ")
                a, b = divmod(-2 - k, _N)
            elif k >= 0:
                out.append(chr(96 + b) if b < 27 else "?")
                a, b = k, a
        return start[a, b][1] + "".join(reversed(out))

    def _words(self, token: str, watch: Watch | None = None) -> list[str]:
        """The words behind a token: whole, and by its parts if it is long; with masks dropped or filled, as is likelier, and all filled."""
        token = _LONG.sub(r"\1\1\1", token)
        whole = [token] if len(token) >= 3 else []
        if len(token) > LONG_TOKEN:
            whole += [p for p in _PART.split(token) if 3 <= len(p) < len(token) and (_HIDDEN.search(p) or _DOUBLE.search(p))]
        if watch is not None:
            whole = [p for p in whole if len(p) > PIECE or watch.may(p)]
        return [self.restore(p) for p in whole] + [self.restore(p, True) for p in whole if not _MASKS.isdisjoint(p)]

    def restored(self, text: str, watch: Watch | None = None) -> set[bytes]:
        """Words behind the suspicious tokens of a lower-case text: a letter doubled, or a character that may be another.

        Numbers, that is tokens of digits and marks that stand for nothing, are what they are. Characters set apart are
        one word where their separators are all alike; they are also decoded with word ends at any separator. With a
        watch, only tokens are decoded that can stand for one of its words.
        """
        out: set[str] = set()
        for token in set(text.split()):
            token = token.strip(_OUTER)
            if _HIDDEN.search(token):
                if any(c.isalpha() or c in STANDS_FOR and not c.isdigit() for c in token):
                    out.update(self._words(token, watch))
            elif _DOUBLE.search(token):
                for part in re.split(r"[^\w]+", token):
                    if _DOUBLE.search(part):
                        out.update(self._words(part, watch))
        for m in _EVEN.finditer(text):
            out.add(self.restore(m.group()))
        for m in _SPACED.finditer(text):
            run = m.group()
            for at in range(0, max(1, len(run) - OVERLAP), PIECE - OVERLAP):
                out.update(self._decode(run[at : at + PIECE], True).split())
        return {w.encode() for w in out if w}


class Watch:
    """Whether a token can stand for any of a set of signs: all positions in all signs as the bits of one number.

    It follows every path of the token's lattice at once, so what it turns down can't be restored to a sign.
    """

    def __init__(self, signs_: set[bytes]):
        self.start = self.whole = self.begun = 0
        self.at: dict[str, int] = {}
        self.take: dict[str, int] = {}
        bit = 0
        for sign in sorted(signs_):
            word, prefix = (sign[:-1], True) if sign.endswith(b"~") else (sign, False)
            if not word or any(not (97 <= c <= 122 or c == 63) for c in word):
                continue  # never what a token is restored to
            self.start |= 1 << bit
            for c in word.decode():
                bit += 1
                self.at[c] = self.at.get(c, 0) | 1 << bit
            if prefix:
                self.begun |= 1 << bit
            else:
                self.whole |= 1 << bit
            bit += 1

    def _takes(self, c: str) -> int:
        if c not in self.take:
            mask = 0
            for x, _ in Channel._readings(c):
                mask |= self.at.get(chr(96 + x) if x < 27 else "?", 0)
            self.take[c] = mask
        return self.take[c]

    def may(self, token: str) -> bool:
        state, last = self.start, ""
        for c in token:
            stays = c in SEPARATORS or c in "*#%!" or c == last or not Channel._readings(c)
            state = (state << 1) & self._takes(c) | (state if stays else 0)
            if state & self.begun:
                return True
            if not state:
                return False
            last = c
        return bool(state & self.whole)


def signs(text: str, channel: Channel, watch: Watch | None = None) -> set[bytes]:
    """Words of a text, as written and restored, and the beginnings of longer ones (marked by a final `~`).

    With a watch, restored words that are none of its signs may be left out.
    """
    low = text.lower()
    found = set(words(low.encode("utf-8", "surrogatepass")))
    found |= channel.restored(low, watch)
    found |= {w.decode("utf-8", "ignore")[:PREFIX].encode() + b"~" for w in found if len(w) > PREFIX}
    return found


class Model:
    """A channel, the base rate and the strength of each sign."""

    def __init__(self, channel: Channel, base: float, strength: dict[bytes, float]):
        self.channel, self.base, self.strength, self.watch = channel, base, strength, Watch(set(strength))

    def score(self, text: str) -> float:
        """Probability of label 1: 1 - (1 - base) prod(1 - strength) over the signs present."""
        rest = 1 - self.base
        for w in self.strength.keys() & signs(text, self.channel, self.watch):
            rest *= 1 - self.strength[w]
        return float(min(1.0, max(0.0, 1 - rest)))


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, *, rows: int = TRAIN_ROWS) -> Model:
    """The channel of all documents; strengths from labelled rows outside the held-out fold (ids with several labels: any 1)."""
    channel = Channel(trigram_counts(docs))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    picked = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < min(1.0, rows / max(1, n)) * (1 << 20)
    # Both sides are cut down before they meet: only texts of about `rows` rows are moved.
    own = docs.where(F.col("doc_id").isNotNull() & picked).select("doc_id", F.col("text").cast("string").alias("text"))
    sample = own.join(known.where(picked), "doc_id").select("text", "toxic")
    shared = Shared(spark, channel)

    def count(batches):
        for b in batches:
            seen: dict[bytes, list[int]] = {b"": [0, 0]}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[b""][y > 0] += 1
                for w in signs(t or "", shared.value):
                    seen.setdefault(w, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["w", "n0", "n1"]
            )

    counted = sample.mapInArrow(count, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = Scratch(spark).cut(counted.where((F.col("n0") + F.col("n1") >= MIN_ROWS) | (F.length("w") == 0)))
    total = counted.where(F.length("w") == 0).first()
    if total is None or not total["n1"]:
        return Model(channel, 0.0, {})
    base = total["n1"] / (total["n0"] + total["n1"])
    all_n = F.col("n0") + F.col("n1")
    z = (F.col("n1") - all_n * base) / F.sqrt(all_n * max(1e-9, base * (1 - base)))
    # All signs come to the driver: each is in MIN_ROWS rows of the sample at least, so the sample bounds them.
    strong = counted.where((F.length("w") > 0) & (all_n >= MIN_ROWS) & (z >= MIN_Z) & (F.col("n1") >= 4 * F.col("n0"))).collect()
    strength = {bytes(r["w"]): (r["n1"] + 0.1) / (r["n0"] + r["n1"] + 0.5) for r in strong}
    # Rows with label 1 but no sign are the base rate; it stays under the threshold of a prediction.
    return Model(channel, min(0.05, base / 4), strength)


def scores(docs: DataFrame, model: Model, spark: SparkSession, *, threshold: float = PREDICT_FROM) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the base rate. Without labelled rows or without any of label 1 every score is 0. Repeated
    rows score alike; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = Shared(spark, model)

    def run(batches):
        for b in batches:
            s = np.array([shared.value.score(t or "") for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
