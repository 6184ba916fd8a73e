"""Secret scan: three fixed patterns, and a battery of randomness tests over every long token.

Pattern spans always stay. Beyond them, every run of 20 or more characters of [A-Za-z0-9+/_=-] is a candidate. Its
encoding is inferred from its characters (decimal digits, hexadecimal, base 32, base 36, base 64); four tests of
uniform randomness over that alphabet are taken: chi-squared of symbol counts, chi-squared of kinds of characters
(letters that are frequent in text, other letters, capitals, digits), which tells words from keys where single symbols
are too few to count, runs above and below the middle of the alphabet, and serial correlation at lags up to LAGS.
Fisher's sum of the log p-values is the token's score: high for words, low for keys.

A score passes up to a cut of the token's encoding and length class. Cuts come from laws, not from the corpus, so a token
gets the same answer whatever stands beside it: scores of random tokens say how many keys a cut finds, scores of
structured ones (words, identifiers, paths, dates, counters, periods, text in hexadecimal) how many others it lets
through. The cut is the highest one, up to the KEPT quantile of random tokens, at which false discoveries stay within FDR
if there are ODDS structured tokens of the worst kind to each random one. A class in which no such cut finds half of the
random tokens reports nothing, nor do the shorter ones of its encoding: short tokens cannot be told from words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import keyed

FDR, ODDS, KEPT, MIN_TOKEN, LAGS = 0.01, 2, 0.97, 20, 8
#: Simulated tokens of a kind in each class.
DRAWS = 4000
#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
#: Length classes: the least length of each; the last is simulated up to twice that.
LENGTHS = (20, 24, 32, 40, 64, 96)
ENCODINGS = ("digits", "hex", "base32", "base36", "base64")
_ALPHABETS = ("0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _codes() -> np.ndarray:
    """Place of each byte in each alphabet, -1 outside; hex and base 36 take either case, base 64 also its URL form."""
    out = np.full((len(_ALPHABETS), 256), -1, np.int16)
    for e, alphabet in enumerate(_ALPHABETS):
        for i, c in enumerate(alphabet):
            out[e, ord(c)] = i
    for e in (1, 3):
        for c in "abcdefghijklmnopqrstuvwxyz":
            out[e, ord(c.upper())] = out[e, ord(c)]
    out[4, ord("-")], out[4, ord("_")] = 62, 63
    return out


CODES, SIZES = _codes(), np.array([len(a) for a in _ALPHABETS])
#: Letters that make up two thirds of running text.
COMMON = "etaoinshr"
#: Symbols of each alphabet in four kinds: frequent letters, other letters, capitals where case counts, digits and signs.
KINDS_OF = np.array([[0, 0, 0, 10], [2, 4, 0, 10], [9, 17, 0, 6], [9, 17, 0, 10], [9, 17, 26, 12]], float)
IS_COMMON = np.isin(np.arange(256), np.frombuffer((COMMON + COMMON.upper()).encode(), np.uint8))
#: How often letters occur in running text, in percent (a to z), and signs that join words in names and paths.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
JOINTS = "/-_"


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal law (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


def battery(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encoding and score of each token (padding '=' left out). Score: Fisher's -2 sum of log p over four tests."""
    bare = [t.rstrip(b"=") or t for t in tokens]
    lens = np.array([len(t) for t in bare])
    data = np.frombuffer(b"".join(bare), np.uint8)
    owner = np.repeat(np.arange(len(bare)), lens)
    starts = np.cumsum(lens) - lens
    encoding = np.full(len(bare), len(ENCODINGS) - 1)
    for e in range(len(ENCODINGS) - 2, -1, -1):
        fits = np.minimum.reduceat(CODES[e][data], starts) >= 0
        encoding[fits] = e
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), starts)
    lower = np.add.reduceat(((data >= 97) & (data <= 122)).astype(np.int64), starts)
    encoding[(upper > 0) & (lower > 0) & (encoding < 4)] = 4  # mixed case is no base 16 or 36
    code = CODES[encoding[owner], data].astype(np.int64)
    code[code < 0] = 0
    k, n = SIZES[encoding].astype(float), lens.astype(float)
    # chi-squared: sum of squared counts, with the normal approximation of Wilson and Hilferty
    counts = np.bincount(owner * 64 + code, minlength=64 * len(bare)).reshape(-1, 64).astype(float)
    squares = (counts**2).sum(1)
    chi = squares * k / n - n
    df = k - 1
    p_chi = _normal_tail(((np.maximum(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    # the same over kinds of characters
    capitals = np.where(encoding == 4, upper, 0)
    letter = upper + lower - capitals
    frequent = np.bincount(owner, IS_COMMON[data] & ~((encoding == 4)[owner] & (data < 97)), len(bare))
    kinds = np.stack([frequent, letter - frequent, capitals, n - letter - capitals], 1)
    wanted = KINDS_OF[encoding] / k[:, None] * n[:, None]
    off = np.where(wanted > 0, (kinds - wanted) ** 2 / np.maximum(wanted, 1e-9), 0).sum(1)
    free = np.maximum((wanted > 0).sum(1) - 1, 1)
    p_kinds = np.where(encoding == 0, 1, _normal_tail(((off / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))))
    same = owner[1:] == owner[:-1]
    high = code >= (SIZES[encoding] // 2)[owner]
    ups = np.bincount(owner, high, len(bare))
    runs = 1 + np.bincount(owner[1:], same & (high[1:] != high[:-1]), len(bare))
    expect = 2 * ups * (n - ups) / n + 1
    spread = np.sqrt(np.maximum((expect - 1) * (expect - 2) / np.maximum(n - 1, 1), 1e-9))
    p_runs = np.where((ups == 0) | (ups == n), 2.0**-n * 2, 2 * _normal_tail(np.abs(runs - expect) / spread))
    centred = code - np.bincount(owner, code, len(bare))[owner] / n[owner]
    var = np.bincount(owner, centred**2, len(bare))
    strongest = np.zeros(len(bare))
    for lag in range(1, LAGS + 1):
        together = owner[lag:] == owner[:-lag]
        tie = np.bincount(owner[lag:], np.where(together, centred[lag:] * centred[:-lag], 0), len(bare)) / np.maximum(var, 1e-9)
        strongest = np.maximum(strongest, np.abs(tie + lag / n / LAGS) * np.sqrt(n))
    p_lag = np.where(var < 1e-9, 1e-12, np.minimum(1, 2 * LAGS * _normal_tail(strongest)))
    score = -2 * sum(np.log(np.clip(p, 1e-12, 1)) for p in (p_chi, p_kinds, p_runs, p_lag))
    return encoding, score


def _class_of(lens: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, lens, "right") - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pool(rng: np.random.Generator, n: int) -> list[str]:
    """Words of letters as frequent as in text."""
    shares = np.array(LETTER_SHARES) / sum(LETTER_SHARES)
    sizes = rng.integers(2, 11, n)
    text, ends = "".join(map(chr, (97 + rng.choice(26, int(sizes.sum()), p=shares)).tolist())), np.cumsum(sizes)
    return [text[b - s : b] for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _structured(enc: int, kind: int, words: list[str], number: int, size: int) -> str:
    """One token that is no key, of an encoding, in its kind's way, as long as asked."""
    said = str(number)
    if enc == 0:
        long = (said.zfill(size), "".join(f"{2024 - k % 3}{k % 12 + 1:02}{k * 7 % 28 + 1:02}" for k in range(number % 50, number % 50 + size // 8 + 1)), "".join(str(number + k) for k in range(size)), said * size)[kind]
    elif enc == 1:
        long = (f"{number:x}".zfill(size), " ".join(words).encode().hex(), "".join(f"{number + k:x}" for k in range(size)), f"{number:x}f" * size)[kind]
    elif enc == 2:
        long = ("".join(words), "".join(w + "234567"[number % 6] * (k % 3 == number % 3) for k, w in enumerate(words)), "".join(w + "23" * (k % 4 == number % 4) for k, w in enumerate(words)), (words[0] + words[1]) * size)[kind].upper()
    elif enc == 3:
        long = ("".join(words), "".join(w + said[:2] * (k % 3 == number % 3) for k, w in enumerate(words)), said + "".join(words), (words[0] + said) * size)[kind]
    else:
        camel = [w.capitalize() for w in words]
        long = ("".join(camel), "".join(w + JOINTS[len(w) % 3] for w in words), "".join(w + said[: len(w) % 3] for w in camel), "".join(w + JOINTS[len(w) % 3] + said[: len(w) % 2] for w in camel))[kind]
    return long[:size] if not long.startswith("0") else long[-size:]


@lru_cache
def cuts(fdr: float = FDR, odds: float = ODDS, kept: float = KEPT) -> tuple[tuple[float, ...], ...]:
    """Highest score that passes, by encoding and length class; -1 where nothing does."""
    rng, out = np.random.default_rng(7), []
    pool = _pool(rng, 20_000)
    for enc, alphabet in enumerate(_ALPHABETS):
        row, symbols = [], np.frombuffer(alphabet.encode(), np.uint8)
        for n, least in enumerate(LENGTHS):
            sizes = rng.integers(least, LENGTHS[n + 1] if n + 1 < len(LENGTHS) else 2 * least, DRAWS)
            drawn, ends = rng.choice(symbols, int(sizes.sum())).tobytes(), np.cumsum(sizes)
            found, score = battery([drawn[b - s : b] for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)])
            random = np.sort(score[found == enc])
            false = []
            for kind in range(4):
                starts, numbers = rng.integers(0, len(pool) - 200, DRAWS // 2).tolist(), rng.integers(1, 10**6, DRAWS // 2).tolist()
                found, score = battery([_structured(enc, kind, pool[a : a + s // 2 + 2], x, s).encode() for a, x, s in zip(starts, numbers, sizes.tolist(), strict=False)])
                false.append(np.sort(score[found == enc]))
            # scores tried from the highest down; one structured token more than seen is assumed to pass
            tried = np.quantile(random, np.arange(kept, 0.49, -0.01))
            finds = np.searchsorted(random, tried, "right") / len(random)
            passes = np.max([(np.searchsorted(f, tried, "right") + 1) / (DRAWS // 2 + 1) for f in false], axis=0)
            good = np.flatnonzero(odds * passes <= fdr * (odds * passes + finds))
            row.append(float(tried[good[0]]) if len(good) else -1.0)
        blind = max((n for n, cut in enumerate(row) if cut < 0), default=-1)
        out.append((-1.0,) * (blind + 1) + tuple(row[blind + 1 :]))
    return tuple(out)


_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("kind", pa.int32()), ("e", pa.int32())]))


def _scan(batches, limits: tuple[tuple[float, ...], ...]):
    """Per text: base spans, and those of the tokens that pass as random."""
    limit = np.array(limits)
    for batch in batches:
        bases, added, owners, spans, tokens = [], [], [], [], []
        for i, data in enumerate(batch.column("text").to_pylist()):
            text = data.decode()
            bases.append(base_spans(text))
            added.append([])
            for m in TOKEN.finditer(text):
                owners.append(i)
                spans.append(m.span())
                tokens.append(m.group().encode())
        if tokens:
            encoding, score = battery(tokens)
            passing = score <= limit[encoding, _class_of(np.array([len(t) for t in tokens]))]
            for k in np.flatnonzero(passing).tolist():
                start, end = spans[k]
                if not any(s < end and start < e for s, _, e in bases[owners[k]]):
                    added[owners[k]].append({"s": start, "kind": 3, "e": end})
        base = [[{"s": s, "kind": k, "e": e} for s, k, e in x] for x in bases]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPAN), pa.array(added, _SPAN)], ["doc_id", "base", "added"])


def scan(docs: DataFrame, fdr: float = FDR, odds: float = ODDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans), added (spans of random tokens), spans by start then kind.

    docs: doc_id, text; other columns are not read. Null text is empty and has no spans. Repeated rows are scanned
    each; texts of any length are read whole; an empty table gives no rows. Positions are code points, ends exclusive. A
    random token that touches a base span is part of it and adds none. odds: structured tokens to a random one that the
    false discovery rate allows for; classes of encoding and length in which half the keys cannot be told at that rate
    report no random token.
    """
    read, limits = keyed(docs), cuts(fdr, odds)
    doc_id = read.schema["doc_id"].dataType.simpleString()
    span = "array<struct<s:int,kind:int,e:int>>"
    seen = read.mapInArrow(lambda it: _scan(it, limits), f"doc_id {doc_id}, base {span}, added {span}")

    def count(kind: int):
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")

    counted = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return seen.select("doc_id", *counted, "base", "added", F.array_sort(F.concat("base", "added")).alias("spans"))


def joined(spans: str) -> F.Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
