"""Problem 2: sentence boundaries in any language and script.

Candidates are terminators with what closes behind them and, in Thai, spaces. The end of a unit is a boundary for sure, and
so is its start. Counts of the words before and after candidates, at those sure places and elsewhere, become features next to
case, length, figures and script, and a maximum-entropy model fitted on a bounded sample of sure cases decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_texts

#: Hash buckets of word counts, which bound what is sent to the workers, and texts of the sample the model is fitted on.
BUCKETS, SAMPLE = 1 << 18, 6000
#: A word expected this often at a sure place and never seen there isn't a boundary (e^-4.6 is one in a hundred).
EXPECTED = 4.6

_CLOSE = "\"”’»)\\]」』】）›“"
_THAI = "฀-๿"
CANDIDATE = re.compile(
    rf"(?P<w>(?:[.!?…]+|(?<=[Ͱ-Ͽἀ-῿\d]);|;)[{_CLOSE}]*(?:[  ]»)?)(?=\s|$|[^\s\da-z{_CLOSE},;:.!?…])"
    rf"|(?P<e>[。！？।॥؟｡]+[{_CLOSE}]*)"
    rf"|(?P<t>(?<=[{_THAI}])(?=\s+\S)|(?<=[^\s.!?。…])(?=\s+[{_THAI}]))"
)
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_BULLET = re.compile(r"^\s*(?:[•▪●◦‣·*–—-]|\(?\d{1,3}[.)]|\(?[a-z]\))\s+")
_OPEN = "\"“„‘«‹([「『（【¿¡"


_RUN = re.compile(r"\s*(\S+)")


def _eastern(ch: str) -> bool:
    return "⺀" <= ch <= "鿿" or "＀" <= ch <= "￯" or "가" <= ch <= "힣"


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def before(text: str, end: int) -> str:
    """The word that ends at `end`, whole and folded; in scripts without spaces its last letters."""
    size = 48
    while True:
        tail = text[max(0, end - size) : end].rstrip()
        pieces = re.split(r"\s", tail)
        # as far back as the word goes
        if size >= end or tail and len(pieces) > 1:
            break
        size *= 4
    if not tail:
        return ""
    core = tail.rstrip("。！？।॥؟｡.!?…;" + "\"”’»)]」』】）›“")
    if core and _eastern(core[-1]):
        return "e" + tail[max(0, len(core) - 2) :]
    if core and _thai(core[-1]):
        return "t" + tail[-6:]
    word = pieces[-1].lstrip(_OPEN)
    return re.sub(r"\d+(?:[.,]\d+)*", "0", word).lower()


def after(text: str, start: int) -> str:
    """The word that starts at or after `start`, whole and folded; in scripts without spaces its first letters."""
    found = _RUN.match(text, start)
    if not found:
        return ""
    head = found.group(1)
    core = head.lstrip(_OPEN) or head
    if _eastern(core[0]):
        return "e" + core[:2]
    if _thai(core[0]):
        return "t" + core[:5]
    word = re.sub(r"\d+", "0", core.rstrip(",;:.!?\"”’»)"))
    quoted = "“" if head[0] in "\"“„«" else ""
    return quoted + (word[:1] + word[1:].lower())


def candidates(text: str) -> list[tuple[int, str]]:
    """(end, kind) of each candidate, the end of the text left out."""
    out, size = [], len(text.rstrip())
    for m in CANDIDATE.finditer(text):
        end = m.end()
        if end >= size:
            break
        if m.lastgroup == "w" and m.group().startswith(";") and not _GREEK.search(text[max(0, m.start() - 12) : m.start()]):
            continue
        if end > 0:
            out.append((end, m.lastgroup))
    return out


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % BUCKETS


def first_and_last(text: str) -> tuple[str | None, str | None]:
    """The word that starts a unit, and the one that ends it, if it ends as a sentence does."""
    body = _BULLET.sub("", text).strip()
    if not body:
        return None, None
    closed = re.search(rf"[.!?…。！？।॥؟｡;][{_CLOSE}]*$|[{_THAI}]$|[  ]»$", body)
    return after(body, 0), before(body, len(body)) if closed else None


def _count(texts: pd.Series) -> Counter:
    seen: Counter = Counter()
    for t in texts:
        if not t:
            continue
        start, end = first_and_last(t)
        if start:
            seen[(0, bucket(start))] += 1
        if end:
            seen[(1, bucket(end))] += 1
        for at, _ in candidates(t):
            seen[(2, bucket(before(t, at)))] += 1
            seen[(3, bucket(after(t, at)))] += 1
    return seen


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for f in frames:
        total += _count(f["t"])
        if len(total) > 500_000:
            yield pd.DataFrame([(k, b, n) for (k, b), n in total.items()], columns=["kind", "bucket", "n"])
            total = Counter()
    yield pd.DataFrame([(k, b, n) for (k, b), n in total.items()], columns=["kind", "bucket", "n"])


def _case(ch: str) -> int:
    k = unicodedata.category(ch) if ch else "Zs"
    return {"Lu": 0, "Lt": 0, "Ll": 1, "Nd": 2}.get(k, 3 if k[0] == "L" else 4)


FEATURES = 26


class Boundaries:
    """Counts in buckets and the weights of the maximum-entropy model."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, inside_before: np.ndarray, inside_after: np.ndarray):
        self.starts, self.ends, self.before, self.after = starts, ends, inside_before, inside_after
        self.weights = np.zeros(FEATURES)
        self.start_rate = starts.sum() / max(1, inside_after.sum())
        self.end_rate = ends.sum() / max(1, inside_before.sum())

    def ratios(self, a: str, b: str) -> tuple[float, float, int, float, int, float]:
        i, j = bucket(a), bucket(b)
        ne, ni, ns, na = int(self.ends[i]), int(self.before[i]), int(self.starts[j]), int(self.after[j])
        # against the rate at which any candidate is at a sure place; rare words stay near zero
        ra = np.log((ne + 0.3) / ((ni + 0.3 / max(self.end_rate, 1e-3)) * max(self.end_rate, 1e-3)))
        rb = np.log((ns + 0.3) / ((na + 0.3 / max(self.start_rate, 1e-3)) * max(self.start_rate, 1e-3)))
        return float(ra), float(rb), ne, ni * self.end_rate, ns, na * self.start_rate

    def features(self, text: str, at: int, kind: str, a: str, b: str, spaced: bool) -> np.ndarray:
        ra, rb, ne, ni, ns, na = self.ratios(a, b)
        core = a.rstrip(".!?…;\"”’»)]")
        first = b.lstrip("“")[:1]
        x = np.zeros(FEATURES)
        x[0] = 1
        x[1], x[2], x[3] = np.clip(ra, -4, 2), np.clip(rb, -4, 2), np.clip(min(ra, rb), -4, 2)
        x[4 + _case(first if kind == "w" else "")] = kind == "w"
        x[9] = kind == "w" and len(core) == 1
        x[10] = kind == "w" and len(core) in (2, 3)
        x[11] = "." in core
        x[12] = core.isdigit() or core == "0"
        x[13] = kind == "e"
        x[14] = kind == "t"
        x[15] = a[-1:] in "\"”’»)]」』"
        x[16] = "!" in a[-3:] or "?" in a[-3:]
        x[17] = not spaced and kind == "w"
        x[18] = ne == 0 and ni >= EXPECTED
        x[19] = ns == 0 and na >= EXPECTED
        x[20] = ne == 0 and ni < EXPECTED
        x[21] = ns == 0 and na < EXPECTED
        x[22] = bool(x[20]) and x[5] > 0
        x[23] = a[-3:] == "..." or a[-1:] == "…"
        x[24] = kind == "t" and (a[-1:].isdigit() or first.isdigit())
        x[25] = not spaced and len(core) < 3
        return x

    def fit(self, texts: list[str]) -> Boundaries:
        rows, truth = [], []
        for a, b, kind, yes in CHECKED:
            rows.append(self.features("", 0, kind, a, b, True))
            truth.append(yes)
        for t in texts:
            start, end = first_and_last(t)
            if start and end:
                kind = "e" if end.startswith("e") or re.search("[।॥؟]", end) else "t" if end.startswith("t") and len(end) > 2 and _thai(end[-1]) else "w"
                rows.append(self.features(t, len(t), kind, end, start, True))
                truth.append(1.0)
            for at, kind in candidates(t):
                a, b = before(t, at), after(t, at)
                _, _, ne, ni, ns, na = self.ratios(a, b)
                never = ne == 0 and ni >= EXPECTED or ns == 0 and na >= EXPECTED
                sure = ne >= 3 and ns >= 3 and ne > 0.1 * ni and ns > 0.1 * na
                if never or sure:
                    rows.append(self.features(t, at, kind, a, b, text_space(t, at)))
                    truth.append(0.0 if never else 1.0)
        x, y = np.array(rows), np.array(truth)
        w = np.zeros(FEATURES)
        for _ in range(30):  # Newton steps of penalised maximum likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(FEATURES)
            step = np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def ends_of(self, text: str | None) -> list[int]:
        """Ends of the sentences of a text, in characters, the last included; a blank text has none."""
        if not text or not text.strip():
            return []
        out = []
        for at, kind in candidates(text):
            a, b = before(text, at), after(text, at)
            if b and self.features(text, at, kind, a, b, text_space(text, at)) @ self.weights > 0:
                out.append(at)
        return [*out, len(text.rstrip())]


#: Hand-checked contexts, so that the model is defined on small tables too. Word before, word after, kind, boundary or not.
CHECKED = (
    ("plan.", "The", "w", 1.0), ("plan.", "In", "w", 1.0), ("plan?", "We", "w", 1.0), ("plan!”", "The", "w", 1.0), ("plan.)", "Our", "w", 1.0), ("haus.", "Das", "w", 1.0),
    ("mr.", "Smith", "w", 0.0), ("dr.", "Jones", "w", 0.0), ("j.", "P", "w", 0.0), ("approx.", "0", "w", 0.0), ("plan.", "and", "w", 0.0), ("ready?”", "asked", "w", 0.0),
    ("0.", "0", "w", 0.0), ("u.s.", "and", "w", 0.0), ("...", "and", "w", 0.0), ("no.", "0", "w", 0.0),
    ("e了。", "e下半", "e", 1.0), ("eた。", "e年度", "e", 1.0), ("e吗？", "e明年", "e", 1.0), ("किया।", "समिति", "e", 1.0), ("e一！”", "e是车", "e", 0.0), ("eる。」", "eと述", "e", 0.0),
    ("tว", "tใน", "t", 1.0), ("0", "tล้าน", "t", 0.0), ("tช่าง", "0", "t", 0.0),
)


def text_space(text: str, at: int) -> bool:
    return at >= len(text) or text[at].isspace()


def fit(df: DataFrame, text_col: str, sample: int = SAMPLE, like: DataFrame | None = None) -> Boundaries:
    """Counts over all texts of df, and weights from `sample` distinct texts with the lowest hash, of `like` if given."""
    texts = df.where(F.length(F.trim(text_col)) > 0).select(F.col(text_col).alias("t"))
    counted = texts.mapInPandas(_counts, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    tables = np.zeros((4, BUCKETS), np.int64)
    got = counted.toPandas()  # at most four counts a bucket
    tables[got["kind"], got["bucket"]] = got["n"]
    few = sample_texts(df if like is None else like, text_col, sample)
    return Boundaries(*tables).fit(few)


def sentence_ends(df: DataFrame, text_col: str, model: Boundaries | None = None, out: str = "sentence_ends") -> DataFrame:
    """Every row of df with `out`, the ends of its sentences in characters of the stored text, a column of that name replaced.

    The last end is that of the text without white space behind it. Null and blank texts have an empty array.
    """
    model = fit(df, text_col) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)  # size fixed by BUCKETS

    def split(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.ends_of(t) for t in texts], dtype=object)

    return df.withColumn(out, F.pandas_udf(split, "array<int>")(F.col(text_col)))


def sentences(df: DataFrame, id_col: str, text_col: str, model: Boundaries | None = None) -> DataFrame:
    """Rows (id_col, sentence_number from 1, start_char, end_char, sentence_text): whole sentences of every row of df.

    Line breaks within a sentence become spaces, in scripts without spaces nothing. Blank texts give no rows.
    """
    ends = sentence_ends(df.select(id_col, text_col), text_col, model, "_ends")

    def cut(texts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, es in zip(texts, ends):
            rows, start = [], 0
            for n, e in enumerate(es, 1):
                piece = t[start:e]
                lead = len(piece) - len(piece.lstrip())
                flat = re.sub(r"(?<=[⺀-鿿぀-ヿ＀-￯฀-๿])\s*\n\s*(?=[⺀-鿿぀-ヿ＀-￯฀-๿])", "", piece.strip())
                rows.append((n, start + lead, int(e), re.sub(r"\s*\n\s*", " ", flat)))
                start = e
            out.append(rows)
        return pd.Series(out, dtype=object)

    kind = "array<struct<sentence_number:int,start_char:int,end_char:int,sentence_text:string>>"
    rows = ends.where(F.size("_ends") > 0).select(id_col, F.explode(F.pandas_udf(cut, kind)(text_col, "_ends")).alias("_s"))
    return rows.select(id_col, "_s.*")
