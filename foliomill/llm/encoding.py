"""Problem 1: text decoded with the wrong encoding.

The distinct words of the corpus that look clean, the runs beyond ASCII in them and their single letters are written in every right encoding
and read in every wrong one. Words of documents are hash-joined against this table of garbled forms: whole, by their runs, and by the
pieces of a run that may stand for one letter. What the table doesn't explain - letters that never stand clean in the corpus,
sequences cut by line ends, lost bytes - goes through an exact check that undoes UTF-8 read wrongly, Cyrillic read as Western or the
reverse, KOI8-R and cp1251 taken for each other, and East Asian encodings read as Western, and verifies the outcome.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_TOKEN, bitmap, cut, fresh, in_bitmap, large, rewrite, salted, spread, text_key

#: Single-byte encodings in which UTF-8 bytes get read, and encodings of other texts with those in which they get read.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "cp1253")
WRONG_WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
LEGACY = (
    ("cp1252", ("cp1251", "mac_roman", "cp437", "cp850", "cp1253", "cp1250")),
    ("cp1251", ("cp1252", "latin-1", "koi8-r", "cp866", "mac_roman")),
    ("koi8-r", ("cp1252", "cp1251")),
    ("cp1253", ("cp1252", "cp1251")),
    ("cp1256", ("cp1252",)),
    ("cp874", ("cp1252",)),
    ("shift_jis", ("cp1252", "latin-1")),
    ("euc_jp", ("cp1252", "latin-1")),
    ("gbk", ("cp1252", "latin-1")),
    ("big5", ("cp1252", "latin-1")),
)
#: Units longer than this are passages of a script without spaces, whose words are its letters: they are garbled and looked up letter by letter.
LONG = 64
#: Characters that one letter takes in a single-byte reading, once or twice, the most first.
PIECES = tuple(range(9, 1, -1))
#: Rounds of the double chains.
TWICE = ("cp1252", "latin-1")
#: A word that looks clean is garbled if its original stands in so many times as many tokens as it does itself.
TIMES = 4

RUN = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_LOST = re.compile("[�\x80-\x9f-]")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-zÀ-ɏ]")
#: Cyrillic letters that look like Latin ones, which other causes put into Latin words.
_TWINS = frozenset("АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԝӏ")
_LATIN_TWINS = frozenset("ABCEHKMOPTXYaceopxyijs")
_ODD_CYRILLIC = re.compile("[ЂЃЉЊЋЌЏђѓљњћќџЎўҐґ]")
#: The commonest Chinese characters, of which right text holds some.
COMMON_HAN = frozenset("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小业部报计公司务市资金产品加工电年度月期本总营增新理管发行成开关")
#: Pairs (read as, right) that turn Cyrillic letters into Cyrillic ones of the other case.
SWAPPED = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"))
#: Fixed value: Russian letters, the commonest first.
LETTERS = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = _EDGE + "«»„“”‘’…–—•"

_tables: dict[str, tuple[list[str], dict[str, int]]] = {}


def _table(name: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; bytes without a character stand for the control of the same number, as browsers read them."""
    if name not in _tables:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _tables[name] = chars, {c: b for b, c in reversed(list(enumerate(chars)))}
    return _tables[name]


def read_as(raw: bytes, wrong: str) -> str:
    chars = _table(wrong)[0]
    return "".join([chars[b] for b in raw])


def garbled_forms(word: str) -> dict[str, str]:
    """Every chain's form of a clean word, as far as it differs from the word; of a letter those of its UTF-8 sequence in single-byte readings."""
    if word[:1] == LETTER:
        raw = word[1:].encode("utf-8", "replace")
        once = {f"utf-8>{wrong}": LETTER + read_as(raw, wrong) for wrong in WRONG}
        return once | {f"utf-8>{wrong}>utf-8>{wrong}": LETTER + read_as(once[f"utf-8>{wrong}"][1:].encode(), wrong) for wrong in TWICE}
    raw, out = word.encode("utf-8", "replace"), {}
    for wrong in WRONG:
        out[f"utf-8>{wrong}"] = read_as(raw, wrong)
    for wrong in WRONG_WIDE:
        out[f"utf-8>{wrong}"] = raw.decode(wrong, "replace")
    for wrong in TWICE:
        out[f"utf-8>{wrong}>utf-8>{wrong}"] = read_as(read_as(raw, wrong).encode(), wrong)
    for right, wrongs in LEGACY:
        try:
            other = word.encode(right)
        except UnicodeEncodeError:
            continue
        for wrong in wrongs:
            out[f"{right}>{wrong}"] = read_as(other, wrong)
        if right in ("cp1252", "cp1251"):
            out[f"{right}>utf-8"] = other.decode("utf-8", "replace")
    return {chain: x for chain, x in out.items() if x != word}


def strange(unit: str) -> bool:
    """Whether a run or word has a look that clean text doesn't: such units are looked up whatever their counts."""
    if _LOST.search(unit) or _ODD_CYRILLIC.search(unit):
        return True
    run = stray = 0
    for ch in unit:
        if "\xc0" <= ch <= "\xff" or "Œ" <= ch <= "ƒ":
            run += 1
            if run >= 3:
                return True
        else:
            run = 0
        if ch > "\x7f" and unicodedata.category(ch) in ("Sm", "So", "Sk", "No", "Sc", "Lm", "Cf", "Zs"):
            stray += 1
    if _CYRILLIC.search(unit) and _LATIN.search(unit) and (len(unit) > 3 or any(_CYRILLIC.match(c) and c not in _TWINS for c in unit)):
        return True
    letters = sum(c > "\x7f" and c.isalpha() for c in unit)
    return bool(stray and letters) or bool(letters and re.search("[–-•‚“-„†‡…‰‹›\xa1-\xbf]", unit) and letters + stray < len(unit)) or stray > 1


def folded(core: str) -> str:
    return re.sub(r"\d", "0", core)


def units(token: str) -> list[str]:
    """What of a token is looked up: the whole without ASCII punctuation around it, and without any, figures folded, and its runs beyond ASCII."""
    return list(dict.fromkeys([*map(folded, _cores(token)), *RUN.findall(token)]))


def _cores(token: str) -> list[str]:
    return [core for core in dict.fromkeys([token.strip(_EDGE), token.strip(_MARKS)]) if not core.isascii() or core == token.strip(_EDGE)]


def wordlike(unit: str, token: str) -> bool:
    """Whether a unit of a token has letters enough to be judged by counts alone: a word of two, a run within a token of three."""
    letters = sum(c.isalpha() for c in unit)
    return letters >= 3 or letters == 2 and unit in map(folded, _cores(token))


#: Ranges of characters that an original may hold.
_RANGES = ((0xA0, 0x17F), (0x192, 0x192), (0x2C6, 0x2DC), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x60C, 0x60C), (0x61B, 0x64A), (0x660, 0x669), (0x67E, 0x6D2), (0x900, 0xDFF), (0xE01, 0xE5B), (0x200B, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x2193), (0x2200, 0x22FF), (0x25A0, 0x25FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))
_JUNK = frozenset("#*<>{}|\\^~=_[]+")


def _plausible(ch: str) -> bool:
    o = ord(ch)
    return any(a <= o <= b for a, b in _RANGES) and unicodedata.category(ch) != "Cn"


def _utf8_parts(segment: str, encode, most_lost: float) -> tuple[str, str] | None:
    """The segment with its valid UTF-8 sequences read rightly, and what they say alone. Characters none of whose bytes belong to one are kept,
    those cut in half become U+FFFD. None if too many of the bytes beyond ASCII belong to none."""
    raw, owner = bytearray(), []
    for i, ch in enumerate(segment):
        piece = encode(ch)
        raw += piece
        owner += [i] * len(piece)
    at, good, pieces, used = 0, 0, [], bytearray(len(raw))
    for m in _UTF8.finditer(bytes(raw)):
        ch = m.group().decode()
        if not _plausible(ch):
            continue
        pieces.append((m.start(), m.end(), ch))
        used[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        good += m.end() - m.start()
    high = sum(b >= 0x80 for b in raw)
    if not good or good < (1 - most_lost) * high:
        return None
    half = {owner[i] for i in range(len(raw)) if used[i]}
    out, done = [], -1

    def gap(upto: int) -> None:
        nonlocal done
        for i in range(at, upto):
            k = owner[i]
            if k > done:
                done = k
                out.append("�" if k in half else segment[k])

    for start, end, ch in pieces:
        gap(start)
        out.append(ch)
        done = max(done, owner[end - 1])
        at = end
    gap(len(raw))
    return re.sub("�+", "�", "".join(out)), "".join(ch for _, _, ch in pieces)


def _bytes(text: str, wrong: str) -> bytes | None:
    back = _table(wrong)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _junk(token: str) -> bool:
    """Signs without a foreign letter among ASCII ones that text hardly has: a broken picture or rule, no wrong decoding."""
    return any(c in _JUNK for c in token) and not any(c > "\x7f" and c.isalpha() for c in token) and not _LOST.search(token)


def undo(token: str) -> str | None:
    """What a token was before one or two wrong readings, verified; None if it doesn't come from one."""
    fixed = None if _junk(token) else _undo(token)
    return fixed and (_undo(fixed) or fixed)


def _undo(token: str) -> str | None:
    wide = [c for c in token if c > "\x7f"]
    if not wide:
        return None
    found = _undo_utf8(token)
    if found and found[0][0] <= 0:
        return found[1]
    return _undo_cyrillic(token) or _undo_swapped(token) or _undo_eastern(token, wide) or found and found[1] or _undo_wide(token, wide) or _undo_letters(token)


def _undo_utf8(token: str) -> tuple[tuple[int, int], str] | None:
    """UTF-8 read in a single-byte encoding: the reading that leaves the fewest characters unexplained, with that number."""
    best = None
    for wrong in WRONG:
        back, parts, new = _table(wrong)[1], [], ""
        strict = wrong not in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
        for known, group in itertools.groupby(token, lambda c: c in back or c == "�"):
            segment = "".join(group)
            got = None
            if known and not segment.isascii():
                # a lost character stands for one byte that belongs to no sequence
                got = _utf8_parts(segment, lambda c: bytes([back.get(c, 0xFF)]), 0.2 if strict else 0.5)
            if got and len(got[1]) == 1:
                ch, pair = got[1], got[1] < "\u0800"
                sure = any(not c.isalpha() for c in segment if c > "\x7f")
                if strict and ch > "ſ" and not "\u2010" <= ch <= "\u25ff" or wrong not in ("cp1252", "latin-1", "cp1251") and pair and not sure or wrong in ("cp1252", "latin-1") and ch > "ſ" and pair and not sure:
                    got = None
            parts.append(got[0] if got else segment)
            new += got[1] if got else ""
        text = "".join(parts)
        if new and text != token:
            rank = sum(c > "\x7f" for c in token) - len(new.encode()), text.count("�")  # characters left unexplained
            if best is None or rank < best[0]:
                best = rank, text
    return best


def _undo_wide(token: str, wide: list[str]) -> str | None:
    """UTF-8 read in a double-byte encoding."""
    if sum("一" <= c <= "鿿" for c in wide) < 2:
        return None
    for wrong in WRONG_WIDE:
        got = _utf8_parts(token, lambda c: c.encode(wrong, "ignore") or b"\xff", 0.4)
        if got and len(got[1]) > 1 and got[0] != token:
            return got[0]
    return None


def _undo_eastern(token: str, wide: list[str]) -> str | None:
    """An East Asian encoding read as Western."""
    narrow = sum("\x80" <= c <= "\xff" or c in _table("cp1252")[1] and c > "\xff" for c in wide)
    if narrow < 4 or narrow != len(wide) or not (_LOST.search(token) or narrow * 2 >= len(token)):
        return None
    raw = _bytes(token, "cp1252")
    for right in ("shift_jis", "gbk", "euc_jp", "big5") if raw else ():
        text = raw.decode(right, "ignore")
        east = sum("、" <= c <= "ヿ" or "一" <= c <= "鿿" for c in text)
        common = sum("、" <= c <= "ヿ" or c in COMMON_HAN for c in text)
        if east >= 3 and east * 2 >= 0.8 * (len(raw) - sum(b < 0x80 for b in raw)) and common * 5 >= east:
            return text
    return None


def _undo_cyrillic(token: str) -> str | None:
    """Cyrillic read as Western: a word of accented letters alone."""
    letters = [c for c in token if c.isalpha()]
    if len(letters) >= 3 and all("\xc0" <= c <= "\xff" or c in "\xa8\xb8" for c in letters):
        raw = _bytes(token, "cp1252")
        if raw:
            text = raw.decode("cp1251", "ignore")
            if all("А" <= c <= "я" or c in "ёЁ" for c in text if c.isalpha()) and not re.search("[а-яё][А-ЯЁ]", text):
                return text
    return None


def _swap(token: str, wrong: str, right: str) -> str | None:
    """A token of Cyrillic letters read in the other Cyrillic encoding; None if it holds or becomes anything else."""
    letters = [c for c in token if c > "\x7f" and c not in _MARKS]
    raw = _bytes("".join(letters), wrong) if letters and all(_CYRILLIC.match(c) for c in letters) and not _LATIN.search(token) else None
    text = read_as(raw, right) if raw else ""
    if not text or not all("А" <= c <= "я" or c in "ёЁ" for c in text):
        return None
    turn = iter(text)
    return "".join(next(turn) if c > "\x7f" and c not in _MARKS else c for c in token)


def _undo_swapped(token: str) -> str | None:
    """KOI8-R and cp1251 taken for each other: a capitalised word, whose letters all change their case."""
    core = token.strip(_MARKS)
    if len(core) > 3 and core[0].islower() and core[1:].isupper():
        # of the two readings the one of commoner letters
        texts = [x for wrong, right in SWAPPED if (x := _swap(token, wrong, right))]
        return min(texts, key=lambda x: sum(map(LETTERS.index, x.strip(_MARKS).lower())), default=None)
    return None


def swapped_runs(text: str, fixed: str) -> str:
    """The repaired text with the words in it that stand unrepaired in a stretch of KOI8-R and cp1251 taken for each other: too short or too rare
    to be judged alone, they go with the repaired words beside them, as far as the stretch reaches in their sentence and their case fits."""
    a, b = re.split(r"([ \t\r\n]+)", text), re.split(r"([ \t\r\n]+)", fixed)
    if len(a) != len(b):
        return fixed
    at = [i for i in range(0, len(a), 2) if a[i]]
    ends = [bool(re.search(r"[.!?…][\"”»)]*$", a[i])) for i in at]
    for wrong, right in SWAPPED:
        known = [a[i] != b[i] == _swap(a[i], wrong, right) for i in at]
        if not any(known):
            continue
        k = 0
        while k < len(at):
            if known[k]:
                k += 1
                continue
            first = k
            while not ends[k] and k + 1 < len(at) and not known[k + 1]:
                k += 1
            starts = first == 0 or ends[first - 1]
            beside = not starts and known[first - 1] or not ends[k] and k + 1 < len(at) and known[k + 1]
            new = [_swap(a[i], wrong, right) if a[i] == b[i] else None for i in at[first : k + 1]]
            if beside and all(x and _cased(x.strip(_MARKS), starts and j == 0) for j, x in enumerate(new)):
                for i, x in zip(at[first : k + 1], new):
                    b[i] = x
            k += 1
    return "".join(b)


def _cased(word: str, starts: bool) -> bool:
    """Whether a word is in small letters, or begins with a capital where it starts a sentence or is a name."""
    return word.islower() and not starts or word[:1].isupper() and (len(word) > 1 and word[1:].islower() or len(word) == 1 and starts)


def _undo_letters(token: str) -> str | None:
    """Western read as Cyrillic within Latin words and figures."""
    if _LATIN.search(token) or re.search(r"\d", token):
        cyrillic = _CYRILLIC.findall(token)
        latin = _LATIN.findall(token)
        if cyrillic and any(c not in _TWINS for c in cyrillic) and (not latin or any(c not in _LATIN_TWINS for c in latin)):
            raw = b"".join(bytes([_table("cp1251")[1][c]]) if c in _table("cp1251")[1] else b"?" for c in cyrillic)
            text = read_as(raw, "cp1252")
            if all(c.isalpha() or c in "€£¥" for c in text) and (len(cyrillic) * 2 <= len(token) or len(cyrillic) == 1):
                turn = iter(text)
                return _CYRILLIC.sub(lambda m: next(turn), token)
    return None


#: Marks letters and their forms, which are looked up apart from words.
LETTER = "\0"


@functools.cache
def _leads_of() -> tuple[frozenset[str], frozenset[str]]:
    """Characters that the first byte of a UTF-8 sequence is read as, and those that the second is."""
    return tuple(frozenset(_table(wrong)[0][b] for wrong in WRONG for b in some) for some in (range(0xC2, 0xF5), range(0x80, 0xC0)))


def pieces(unit: str) -> set[str]:
    """What of a unit may be the form of one letter in UTF-8, whose sequences show where they begin."""
    first, second = _leads_of()
    found = set()
    for run in RUN.findall(unit):
        for i in range(len(run) - 1):
            if run[i] in first and run[i + 1] in second:
                found.update(run[i : i + size] for size in PIECES if i + size <= len(run))
    return {x for x in found if "�" not in x and strange(x)}


def in_pieces(run: str, found: dict[str, str]) -> str:
    """The run read letter by letter, the longest forms first; as it was if that leaves anything of it unexplained."""
    out, i = [], 0
    while i < len(run):
        size = next((k for k in PIECES if LETTER + run[i : i + k] in found), 0)
        if not size:
            return run
        out.append(found[LETTER + run[i : i + size]][1:])
        i += size
    return "".join(out)


def _units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units by the hashes of their token; the token itself stands in one row, without a unit, and clean letters belong to none."""
    for f in batches:
        rows: list[tuple] = []
        letters: Counter = Counter()
        for a, b, t, n in zip(f["_k1"], f["_k2"], f["token"], f["n"]):
            rows.append((a, b, t, "", False, False, n))
            for u in units(t):
                odd = strange(u)
                if len(u) <= LONG:
                    rows.append((a, b, None, u, odd, wordlike(u, t), n))
                if odd:
                    rows += [(a, b, None, LETTER + x, True, False, n) for x in pieces(u)]
                else:
                    letters.update({x: n for x in {*u} if x > "\x7f" and not strange(x)})
        rows += [(0, 0, None, LETTER + x, False, False, n) for x, n in letters.items()]
        yield pd.DataFrame(rows, columns=["_k1", "_k2", "token", "unit", "strange", "wordlike", "n"])


def _forms(shared: Broadcast) -> Callable:
    """The table of garbled forms, those left out that the bitmap of the units looked up doesn't hold."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for f in batches:
            rows = [(g, u, chain, n) for u, n in zip(f["unit"], f["n"]) for chain, g in garbled_forms(u).items() if not g.isascii() and in_bitmap(bits, g)]
            yield pd.DataFrame(rows, columns=["unit", "original", "chain", "n"])

    return forms


def repair_token(token: str, found: dict[str, str]) -> tuple[str, str] | None:
    """The token with looked-up originals in place, then the exact check on what is left, and by which way; None if it isn't garbled.

    A token that holds lost characters is garbled even if they can't be brought back: then it comes back as it is. Ways are TABLE, CHECK
    (the table has nothing of the token), BOTH and LOST.
    """
    if _junk(token):
        return None
    for core in _cores(token):
        key = folded(core)
        if key in found and len(re.findall(r"\d", core)) == found[key].count("0"):
            figures = iter(re.findall(r"\d", core))
            return token.replace(core, re.sub("0", lambda m: next(figures), found[key]), 1), "TABLE"
    # a run of lost characters alone could have been anything
    out = RUN.sub(lambda m: m.group() if not m.group().strip("�") else found.get(m.group()) or in_pieces(m.group(), found), token)
    left = undo(out)
    if left is not None:
        return left, "CHECK" if out == token else "BOTH"
    return (out, "TABLE" if out != token else "LOST") if out != token or _LOST.search(token) else None


def _tokens(df: DataFrame, text_col: str) -> DataFrame:
    t = F.col(text_col)
    return df.where(t.isNotNull() & t.rlike(r"[^\x00-\x7F]")).select(F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(WIDE_TOKEN), F.lit(0)))).alias("token"))


def garbled_tokens(df: DataFrame, text_col: str, of: DataFrame | None = None) -> DataFrame:
    """(token, fixed, way): the distinct garbled tokens of the whole table, or of `of` alone, with the originals that the whole table gives."""
    key = ["_k1", "_k2"]
    tokens = _tokens(df, text_col).groupBy("token").agg(F.count("*").alias("n")).select(*text_key(F.col("token")), "token", "n")
    parts = cut(spread(tokens).mapInPandas(_units_of, "_k1 long, _k2 long, token string, unit string, strange boolean, wordlike boolean, n long"))
    clean = parts.where("not strange and length(unit) > 0").groupBy("unit").agg(F.sum("n").alias("n"))
    asked = parts if of is None else parts.join(large(_tokens(of, text_col).select(*text_key(F.col("token"))).distinct()), key, "left_semi")
    wanted = asked.where("length(unit) > 0 and (strange or wordlike)").select(*key, "unit", "strange")
    looked_up = df.sparkSession.sparkContext.broadcast(bitmap(wanted, "unit"))  # of fixed size
    # one original a form before anything is joined: a lost character is the form of thousands
    table = spread(clean).mapInPandas(_forms(looked_up), "unit string, original string, chain string, n long").groupBy("unit").agg(F.max_by("original", F.struct("n", "original")).alias("original"), F.max("n").alias("n"))
    # forms made of plain letters look like any word: only their counts tell
    own = clean.select("unit", F.col("n").alias("own"))
    best = wanted.select("unit", "strange").distinct().join(large(table), "unit").join(large(own), "unit", "left").where(f"strange or n >= own * {TIMES}").select("unit", "strange", "original")
    found = salted(wanted, best, ["unit", "strange"], F.col("_k1")).groupBy(*key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("unit", "original")))).alias("found"))
    every = spread(asked.where("unit = ''").select(*key, "token").join(large(found), key, "left"))

    def repair(token: pd.Series, maps: pd.Series) -> pd.DataFrame:
        rows = [repair_token(t, dict(m) if m is not None else {}) or (None, None) for t, m in zip(token, maps)]
        return pd.DataFrame(rows, columns=["fixed", "way"])

    return every.select("token", F.pandas_udf(repair, "fixed string, way string")("token", "found").alias("_r")).where("_r.fixed is not null").select("token", "_r.*")


def repair_encoding(df: DataFrame, text_col: str, out: str = "repaired_text", corpus: DataFrame | None = None) -> DataFrame:
    """Every row of df with `out`, the text as it was before wrong decoding, and `garbled`; columns of those names are replaced.

    Clean words and counts come from all texts of `corpus`, a table with the same text column that holds those of df; it is df if not given.
    Bytes that the wrong decoding lost for good stay as U+FFFD. Null stays null and isn't garbled. Equal texts get equal results.
    """
    base = df.drop(*[c for c in (out, "garbled") if c != text_col])
    before = text_col if out != text_col else fresh(base, "before")
    kept = base if before == text_col else base.withColumn(before, F.col(text_col))
    mapping = garbled_tokens(base, text_col) if corpus is None else garbled_tokens(corpus, text_col, base)
    done = rewrite(kept, text_col, mapping, out, WIDE_TOKEN).withColumn("garbled", F.col(f"{out}_hits").isNotNull())

    def stretch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([swapped_runs(x, y) if x != y and x is not None else y for x, y in zip(a, b)], dtype=object)

    # no other text is looked at again
    swapped = F.when(F.col("garbled") & F.col(before).rlike("[Ѐ-ӿ]"), F.col(before))
    done = done.withColumn(out, F.coalesce(F.pandas_udf(stretch, "string")(swapped, F.when(swapped.isNotNull(), F.col(out))), F.col(out))).drop(f"{out}_hits")
    return done if before == text_col else done.drop(before)
