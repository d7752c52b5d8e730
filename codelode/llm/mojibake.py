"""Texts read in a wrong encoding: found and restored by treating code-page swaps as substitution ciphers.

Letter bigrams of each language are counted over all texts. A passage is explained either as
it stands or as the image of a likelier text under a swap (bytes of one encoding read in another).
The swaps' tables start from the public code pages; expectation-maximization per source weighs the swaps, and learns the letters
behind symbols of passages that no table explains. The mapping is applied with ``str.translate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bigrams are counted in so many cells a language, whatever the alphabet: the model has a fixed size.
BITS = 16
CELLS = 1 << BITS
#: Log odds of a swap against a clean passage before EM has seen the source.
PRIOR = -7.0
ROUNDS = 4
#: Languages with a model of their own; the texts of all others share one.
LANGUAGES = 40
#: A passage is strange if the mean log probability of its neighbours outside ASCII is so far below the usual one.
MARGIN = 2.0
#: A line with so few such neighbours, as one letter has, is also judged together with the others of its text.
SHORT = 2
# Public names of encodings.
SINGLE = (
    "cp1252 latin_1 cp1250 cp1251 cp1254 cp1253 cp1257 iso8859_2 iso8859_5 iso8859_9 iso8859_15 koi8_r koi8_u cp866 cp855 cp437 cp850 cp852 cp857 cp861 "
    "mac_roman mac_cyrillic mac_latin2 mac_turkish mac_iceland"
).split()
WIDE = "euc_jp cp932 gb18030 big5 euc_kr".split()


@lru_cache(maxsize=None)
def page(encoding: str) -> tuple[str, ...]:
    """The 256 characters of a code page; a byte without one stands for its C1 control."""
    return tuple(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=None)
def to_byte(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(page(encoding))))}


@lru_cache(maxsize=None)
def upper_half(encoding: str) -> frozenset[str]:
    return frozenset(page(encoding)[128:])


@lru_cache(maxsize=None)
def swap_table(read_as: str, meant: str) -> dict[int, str]:
    """The substitution that undoes bytes of ``meant`` read as ``read_as``."""
    wrong, right = page(read_as), page(meant)
    return {ord(wrong[b]): right[b] for b in range(128, 256) if wrong[b] != right[b]}


@lru_cache(maxsize=100_000)
def _undo_wide(run: str, read_as: str, meant: str) -> str:
    """``run`` re-read in a multi-byte encoding; characters that are no part of a sequence stay."""
    out, at = [], 0
    bytes_of = to_byte(read_as) if read_as in SINGLE else None
    while at < len(run):
        end = at
        if bytes_of is not None:
            while end < len(run) and run[end] in bytes_of:
                end += 1
            raw = bytes(bytes_of[c] for c in run[at:end])
        else:
            raw = b""
            while end < len(run):
                try:
                    raw += run[end].encode(read_as)
                except UnicodeEncodeError:
                    break
                end += 1
        if end == at:
            out.append(run[at])
            at += 1
            continue
        if bytes_of is None or meant != "utf-8":
            try:
                out.append(raw.decode(meant))
            except UnicodeDecodeError:
                out.append(run[at:end])
        else:
            text = raw.decode("utf-8", "surrogateescape")
            out.append(re.sub("[\udc80-\udcff]", lambda m: page(read_as)[ord(m[0]) - 0xDC00], text))
        at = end
    return "".join(out)


_RUN = re.compile(r"[^\x00-\x7f]+")
#: What no correct reading gives: the replacement character and C1 controls other than next line.
_NEVER = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
#: First bytes of UTF-8 sequences whose others were replaced by question marks, or dropped more than once; signs of loss in a strange line.
_LOST = re.compile("[\xc2\xc3\xc4\xc5\xd0\xd1]\\?|[\xe2-\xe9](?:\\?\\?|\\?[^\x00-\x7f\\w]|[^\x00-\x7f\\w]\\?)|\xf0\\?\\?\\?|[\xc2\xe2].*[\xc2\xe2]")
_WORDLIKE = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]|[^\W\x00-\x7f]")
_WIDE_RUN = re.compile(r"[^\x00-\x7f][^\x00-\x1f]*")


def undo(line: str, swap: str) -> str:
    """``line`` with the swap ``meant<read_as`` undone wherever it applies."""
    meant, _, read_as = swap.partition("<")
    if meant == "utf-8":
        return _RUN.sub(lambda m: _undo_wide(m[0], read_as, meant), line)
    if meant in WIDE:
        return _WIDE_RUN.sub(lambda m: _undo_wide(m[0], read_as, meant), line)
    return line.translate(swap_table(read_as, meant))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def points(text: str) -> np.ndarray:
    """Code points, ASCII letters in lower case and digits as one."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    p[(p >= 65) & (p <= 90)] += 32
    p[(p >= 48) & (p <= 57)] = 48
    return p


_LETTER = np.array([chr(c).isalpha() for c in range(0xFFFF)] + [False])


def letter_pairs(p: np.ndarray) -> np.ndarray:
    """Which neighbours are a character outside ASCII and a letter, or one that is both; signs that stand alone say little about an encoding."""
    letter, high = _LETTER[np.minimum(p, 0xFFFF)], p > 127
    return (letter[:-1] | letter[1:]) & (high[:-1] | high[1:])


def cells(p: np.ndarray) -> np.ndarray:
    """The cell of every pair of neighbours."""
    x = p[:-1].astype(np.uint64) * _A + p[1:].astype(np.uint64) * _B
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Bigrams:
    """Log probabilities of neighbours by language, and their usual value where a letter outside ASCII takes part."""

    def __init__(self, languages: list[str], counts: np.ndarray, high: np.ndarray) -> None:
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.ascontiguousarray(np.log((counts + 0.05) / (total + 0.05 * CELLS)).astype(np.float32).T)
        self.usual = (high * self.log.T).sum(axis=1) / np.maximum(1, high.sum(axis=1))

    def score(self, text: str) -> float:
        """The log probability of a text in the language it fits best."""
        return float(self.log[cells(points(" " + text + " "))].sum(axis=0).max())

    def line_scores(self, lines: list[str]) -> np.ndarray:
        """:meth:`score` of each of some lines at once."""
        p = points("".join(f" {x} " for x in lines) + " ")
        size = np.array([len(x) + 2 for x in lines])
        return np.add.reduceat(self.log[cells(p)], np.cumsum(size) - size, axis=0).max(axis=1)

    def parts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """By language, the log probability of neighbours without and with a letter outside ASCII; and how many the latter are."""
        p = points(" " + text + " ")
        high = letter_pairs(p)
        each = self.log[cells(p)]
        return each[~high].sum(axis=0), each[high].sum(axis=0), int(high.sum())

    def strange(self, text: str, least: int = 1) -> bool:
        """Whether the neighbours outside ASCII, ``least`` or more, are unusual in the language that fits best."""
        low, high, n = self.parts(text)
        best = int((low + high).argmax())
        return bool(n >= least and high[best] / n < self.usual[best] - MARGIN)

    def strange_lines(self, lines: list[str], texts: list[int] | None = None) -> list[bool]:
        """:meth:`strange` of many lines at once; short lines also if those of their text are strange together, ``texts`` being its number."""
        if not lines:
            return []
        p = points("".join(f" {x} " for x in lines))
        size = np.array([len(x) + 2 for x in lines])
        starts = np.cumsum(size) - size
        high = letter_pairs(p)[:, None]
        each = self.log[cells(p)]
        total, above, n = (np.add.reduceat(x, starts, axis=0) for x in (each, each * high, high[:, 0].astype(np.int64)))
        best = total.argmax(axis=1)
        mean = above[np.arange(len(lines)), best] / np.maximum(1, n)
        odd = (n > 0) & (mean < self.usual[best] - MARGIN)
        short = (n > 0) & (n <= SHORT)
        if short.any():
            _, of = np.unique(np.zeros(len(lines)) if texts is None else texts, return_inverse=True)
            pools = [np.zeros((of.max() + 1, *x.shape[1:])) for x in (total, above, n)]
            for pool, x in zip(pools, (total, above, n), strict=True):
                np.add.at(pool, of[short], x[short])
            best = pools[0].argmax(axis=1)
            mean = pools[1][np.arange(len(best)), best] / np.maximum(1, pools[2])
            odd |= short & (mean < self.usual[best] - MARGIN)[of]
        return odd.tolist()


def count_bigrams(documents: DataFrame, most: int = LANGUAGES) -> Bigrams:
    """The model over all texts, by language as far as the first two letters of its name tell.

    Texts without a language count together, and so do those of all languages beyond the ``most`` of most texts, so at most
    ``(most + 1) * CELLS`` counts come to the driver whatever stands in ``lang``.
    """
    name = F.coalesce(F.regexp_extract(F.lower("lang"), "^([a-z]{2})", 1), F.lit(""))
    rows = documents.where("text is not null").select(name.alias("lang"), "text")
    kept = [r["lang"] for r in rows.where("lang <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(kept), F.col("lang")).otherwise(F.lit("")) if kept else F.lit(""))
    counted = rows.mapInArrow(_count_rows, "lang string, cell int, n long, high long").groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))
    found = counted.toArrow()
    languages = sorted(set(found["lang"].to_pylist())) or ["en"]
    counts, high = np.zeros((len(languages), CELLS)), np.zeros((len(languages), CELLS))
    index = {x: i for i, x in enumerate(languages)}
    lang = np.array([index[x] for x in found["lang"].to_pylist()], np.int64)
    counts[lang, found["cell"].to_numpy()] = found["n"].to_numpy()
    high[lang, found["cell"].to_numpy()] = found["high"].to_numpy()
    return Bigrams(languages, counts, high)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            n = count_cells("\n".join(["", *texts, ""]))
            counts[lang] = counts[lang] + n if lang in counts else n
    for lang, n in counts.items():
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["lang", "cell", "n", "high"]
        )


def count_cells(text: str) -> np.ndarray:
    """Two rows: counts of all neighbours by cell, and of those that :func:`letter_pairs` takes."""
    p = points(text)
    at = cells(p)
    return np.stack((np.bincount(at, minlength=CELLS), np.bincount(at[letter_pairs(p)], minlength=CELLS)))


def swaps_for(text: str) -> list[str]:
    """The swaps of other encodings than UTF-8 whose wrong side holds the characters of ``text`` outside ASCII."""
    chars = {c for c in text if c > "\x7f" and c != "�"}
    holds = [e for e in SINGLE if len(chars & upper_half(e)) >= 0.7 * len(chars)]
    out = []
    for read_as in holds:
        out += [f"{w}<{read_as}" for w in WIDE]
        if chars <= upper_half(read_as):
            out += [f"{meant}<{read_as}" for meant in SINGLE if meant != read_as]
    return out


def suspects(texts: list[str], model: Bigrams) -> list[list[int]]:
    """For each text the numbers of its lines that may be garbled."""
    out: list[list[int]] = []
    asked: list[tuple[int, int]] = []
    lines: list[str] = []
    for k, text in enumerate(texts):
        found = []
        for i, line in enumerate(text.split("\n")):
            if line.isascii():
                continue
            if _NEVER.search(line) or _decodes(line):
                found.append(i)
            elif _WORDLIKE.search(line):
                asked.append((k, i))
                lines.append(line)
        out.append(found)
    for (k, i), odd in zip(asked, model.strange_lines(lines, [k for k, _ in asked]), strict=True):
        if odd:
            out[k].append(i)
    return [sorted(x) for x in out]


def examine(text: str, odd: list[int], model: Bigrams) -> tuple[list[tuple[str, float]], bool, bool]:
    """All swaps that make the lines ``odd`` of ``text`` likelier, as (swap, gain in log probability); whether
    the text holds what no correct reading gives; whether strange passages are left that no swap explains."""
    lines = text.split("\n")
    broken = bool(_NEVER.search(text))
    if not odd:
        return [], broken, False
    passages = [lines[i] for i in odd]
    joined = "\n".join(passages)
    fixed = model.parts(joined)
    base = model.line_scores(passages)
    found: list[tuple[str, float]] = []
    seen: set = set()

    def weigh_up(swap: str, again: str) -> None:
        gain, before, scores = 0.0, joined, base
        while again != before and again not in seen:
            seen.add(again)
            new = model.line_scores(again.split("\n"))
            if (more := float(np.maximum(new - scores, 0.0).sum())) <= 0:
                break
            # A further layer is undone in the lines that were likelier for the one before.
            again = "\n".join(x if better else y for x, y, better in zip(again.split("\n"), before.split("\n"), new > scores, strict=True))
            gain, before, scores = gain + more, again, np.maximum(new, scores)
            again = undo(before, swap)
        if gain > 0:
            found.append((swap, gain))

    chars = {c for c in joined if c > "\x7f" and c != "\ufffd"}
    wide = [e for e in WIDE if any("\u3000" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7ff" for c in chars)]
    settled = False
    for read_as in (*(e for e in SINGLE if 2 * len(chars & upper_half(e)) >= len(chars)), *wide):
        again = undo(joined, f"utf-8<{read_as}")
        weigh_up(f"utf-8<{read_as}", again)
        if found and found[-1][0] == f"utf-8<{read_as}" and not model.strange(again):
            settled = True
            if chars <= upper_half(read_as) and not _decodes(again):
                break
    # A line that merely can be read as UTF-8 (as some clean Cyrillic can) is tried for that alone.
    strange = model.strange_lines([lines[i] for i in odd])
    broken = broken or any(s and _LOST.search(lines[i]) for s, i in zip(strange, odd, strict=True))
    if not settled and (broken or any(strange)):
        dense = 4 * sum(c > "\x7f" for c in joined) > len(joined)
        one_for_one = _OneForOne(passages, model)
        for swap in swaps_for(joined):
            if swap.partition("<")[0] in WIDE:
                if dense:
                    weigh_up(swap, undo(joined, swap))
            elif (gain := one_for_one.gain(swap)) > 0:
                found.append((swap, gain))
    return found, broken, not found and fixed[2] >= 12 and any(strange)


def restore(text: str, odd: list[int], swap: str, model: Bigrams) -> str:
    """``text`` with the swap undone in those lines ``odd`` that it makes likelier, as many layers deep as each is likelier than the one before."""
    lines = text.split("\n")
    for i in odd:
        now = model.score(lines[i])
        while (again := undo(lines[i], swap)) != lines[i] and (score := model.score(again)) > now:
            lines[i], now = again, score
    return "\n".join(lines)


class _OneForOne:
    """Gains of single-byte swaps of some lines: only neighbours outside ASCII change, and each table is looked up once per character."""

    def __init__(self, lines: list[str], model: Bigrams) -> None:
        self.model, self.points = model, points("".join(f" {x} " for x in lines) + " ")
        size = np.array([len(x) + 2 for x in lines])
        high = self.points > 127
        self.at = np.flatnonzero(high)
        self.pairs = np.flatnonzero(high[:-1] | high[1:])
        self.chars, self.which = np.unique(self.points[self.at], return_inverse=True)
        each = model.log[cells(self.points)]
        total = np.add.reduceat(each, np.cumsum(size) - size, axis=0)
        # Every odd line has a character outside ASCII, so each has pairs, and they stand in order.
        owner = np.repeat(np.arange(len(lines)), size)[self.pairs]
        self.first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        self.owner = owner[self.first]
        self.base = total.max(axis=1)[self.owner]
        self.low = total[self.owner] - np.add.reduceat(each[self.pairs], self.first, axis=0)
        self.seen: set[tuple[int, ...]] = set()

    def gain(self, swap: str) -> float:
        meant, _, read_as = swap.partition("<")
        table = swap_table(read_as, meant)
        new = tuple(ord(table[c]) if c in table else c for c in self.chars.tolist())
        if new in self.seen:
            return 0.0
        self.seen.add(new)
        p = self.points.copy()
        p[self.at] = np.array(new, np.uint32)[self.which]
        x = p[self.pairs].astype(np.uint64) * _A + p[self.pairs + 1].astype(np.uint64) * _B
        each = self.model.log[(x >> np.uint64(64 - BITS)).astype(np.int64)]
        scores = (self.low + np.add.reduceat(each, self.first, axis=0)).max(axis=1)
        return float(np.maximum(scores - self.base, 0.0).sum())


_LEADS = re.compile("[\xc0-\xf4\u0100-\u2fff][^\x00-\x7f]")


def _decodes(line: str) -> bool:
    """Whether some run of the line is a UTF-8 sequence in a common code page."""
    for run in _RUN.findall(line):
        if len(run) > 1 and _LEADS.search(run):
            for e in ("cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "koi8_r"):
                if _undo_wide(run, e, "utf-8") != run:
                    return True
    return False


_EXPLAINED = "doc_id long, source string, text string, odd array<int>, ways array<struct<swap string, gain double>>, broken boolean, unknown boolean"


def _examine_rows(model: Bigrams):
    way = pa.list_(pa.struct([("swap", pa.string()), ("gain", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            rows = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[2] and not r[2].isascii()]
            for at in range(0, len(rows), 200):
                some = rows[at : at + 200]
                for (i, source, text), odd in zip(some, suspects([r[2] for r in some], model), strict=True):
                    ways, broken, left = examine(text, odd, model)
                    if odd and (ways or broken or left):
                        out.append((i, source, text, odd, [{"swap": s, "gain": g} for s, g in ways], broken, left))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), way, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "source", "text", "odd", "ways", "broken", "unknown"],
            )

    return run


def explanations(documents: DataFrame, model: Bigrams) -> DataFrame:
    """Each suspicious text with its odd lines and all the ways to explain them; clean texts give no row."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(_examine_rows(model), _EXPLAINED)


def weigh(explained: DataFrame, documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Expectation-maximization of the swaps' shares in each source; adds ``odds``, the log odds of the swap against a clean text.

    ``explained`` is read in every round: pass a written table. Each round is a grouped sum over the suspicious texts only.
    """
    size = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("size"))
    known = explained.select("doc_id", "source", "broken", F.inline("ways")).join(size, "source")
    share = F.lit(PRIOR)
    now = known.withColumn("odds", F.col("gain") + share)
    for _ in range(rounds):
        # The posterior of each explanation of a text among its others and the clean reading.
        top = Window.partitionBy("doc_id")
        most = F.greatest(F.max("odds").over(top), F.lit(0.0))
        weight = F.exp(F.col("odds") - most) / (F.exp(-most) + F.sum(F.exp(F.col("odds") - most)).over(top))
        shares = (
            now.withColumn("weight", weight)
            .groupBy("source", "swap")
            .agg(((F.sum("weight") + 0.01) / (F.first("size") + 1)).alias("share"))
        )
        now = known.join(shares, ["source", "swap"]).withColumn("odds", F.col("gain") + F.greatest(F.log("share"), F.lit(-12.0))).drop("share")
    return now


def learn_mapping(unknown: DataFrame, model: Bigrams, letters: str, rounds: int = 6) -> dict[str, dict[int, str]]:
    """For each source, the letters behind the symbols of passages no code page explains.

    Expectation: for each symbol between two neighbours, the posterior of each letter under
    the bigrams and the mapping so far. Maximization: the mapping by the expected counts, summed on the executors.
    What comes to the driver is the mapping, a row for each source, symbol and letter of some weight, which the alphabets bound.
    """
    theta: dict[str, dict[str, np.ndarray]] = {}
    for _ in range(rounds):
        rows = unknown.select("source", "text").mapInArrow(_expect(model, letters, theta), "source string, symbol string, letter int, n double")
        summed = rows.groupBy("source", "symbol", "letter").agg(F.sum("n").alias("n"))
        theta = {}
        for r in summed.collect():
            theta.setdefault(r["source"], {}).setdefault(r["symbol"], np.full(len(letters), 1e-3))[r["letter"]] += r["n"]
        for by in theta.values():
            for x in by.values():
                x /= x.sum()
    return {
        source: {ord(s): letters[int(p.argmax())] for s, p in by.items() if p.max() > 0.6} for source, by in theta.items()
    }


def _expect(model: Bigrams, letters: str, theta: dict[str, dict[str, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        options = points(letters)
        for b in batches:
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for line in text.split("\n"):
                    if line.isascii() or not model.strange(line):
                        continue
                    ascii_part = "".join(c if c < "\x80" else " " for c in line)
                    lang = int(model.log[cells(points(" " + ascii_part + " "))].sum(axis=0).argmax())
                    table = model.log[:, lang]
                    guess = {s: letters[int(p.argmax())] for s, p in theta.get(source, {}).items()}
                    for m in re.finditer(r"[^\x00-\x7f]", line):
                        s = m[0]
                        left = line[m.start() - 1] if m.start() else " "
                        right = line[m.end()] if m.end() < len(line) else " "
                        a, z = (points(guess.get(x, x))[0] for x in (left, right))
                        score = table[cells(np.ravel(np.column_stack((np.full_like(options, a), options))))[::2]].astype(np.float64)
                        score += table[cells(np.ravel(np.column_stack((options, np.full_like(options, z)))))[::2]]
                        p = np.exp(score - score.max()) * theta.get(source, {}).get(s, 1.0)
                        p /= p.sum()
                        k = (source, s)
                        sums[k] = sums[k] + p if k in sums else p
        out = [(*k, int(j), float(x[j])) for k, x in sums.items() for j in np.flatnonzero(x > 1e-6)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["source", "symbol", "letter", "n"])

    return run


def letters_of(model: Bigrams) -> str:
    """The letters of the code pages' upper halves, as far as two cases belong to them."""
    return "".join(sorted({c for e in SINGLE for c in upper_half(e) if c.isalpha() and c.lower() != c.upper()}))


def settle(explained: DataFrame, documents: DataFrame, model: Bigrams) -> DataFrame:
    """``(doc_id, swap, restored)`` of the texts that are garbled, whole or in part, once each.

    ``swap`` is ``meant<read_as``, ``learned`` for a mapping found by EM alone, or null, with the text as it is, where what was lost cannot be
    had back. A null or empty text, and correct text of any language, gives no row. ``explained`` is read more than once: pass a written table.
    """
    weighed = weigh(explained, documents)
    best = (
        weighed.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("odds").desc(), "swap")))
        .where("rank = 1 and (odds > 0 or broken)")
        .select("doc_id", F.when(F.col("odds") > 0, F.col("swap")).alias("swap"))
    )
    texts = explained.select("doc_id", "source", "text", "odd")
    lost = explained.where("size(ways) = 0 and broken").select("doc_id", F.lit(None).cast("string").alias("swap"))
    named = best.unionByName(lost).join(texts, "doc_id").select("doc_id", "swap", "text", "odd").mapInArrow(_restore_rows(model), "doc_id long, swap string, restored string")
    unknown = explained.where("unknown and not broken")
    mapping = learn_mapping(unknown, model, letters_of(model))
    learned = unknown.select("doc_id", "source", "text").mapInArrow(_apply(mapping, model), "doc_id long, swap string, restored string")
    return named.unionByName(learned).dropDuplicates(["doc_id"])


def _restore_rows(model: Bigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restore(text, odd, swap, model) if swap else text for _, swap, text, odd in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "swap", "restored"])

    return run


def _apply(mapping: dict[str, dict[int, str]], model: Bigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = text.translate(mapping.get(source, {}))
                high = sum(c > "\x7f" for c in text)
                # A learned mapping has been fitted to these very texts: it must earn its many free letters.
                if new != text and model.score(new) - model.score(text) > 20 + 3 * high and not any(model.strange(x, SHORT + 1) for x in new.split("\n") if not x.isascii()):
                    ids.append(i)
                    texts.append(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(["learned"] * len(ids), pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "swap", "restored"],
            )

    return run
