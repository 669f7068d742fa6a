"""Problem 6: one form for text that looks the same.

The distinct words that hold anything out of form are exploded to positioned code points and joined with a table of
decompositions and stand-ins, which Unicode bounds to a few thousand rows. Combining marks are put in the order of
their classes, words are recomposed and go back into their texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WIDE_TOKEN, cut, large, rewrite, spread

#: Letters of other scripts that look like Latin ones, each followed by the Latin letter.
CYRILLIC_TWINS = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY аa еe іi јj оo рp сc уy хx ѕs һh ԁd ԛq ԝw ӏl ғf"
GREEK_TWINS = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi κk νv οo ρp υu χx ϲc ϳj γy ηn τt ωw"
#: Code point ranges whose compatibility forms stand in for plain characters. Signs such as the
#: numero sign, superscripts, fractions and the ellipsis are ordinary and aren't among them.
COMPATIBLE = (
    (0x2011, 0x2011), (0x2100, 0x2102), (0x210A, 0x2113), (0x2115, 0x2115), (0x2119, 0x211D), (0x2124, 0x2124), (0x2126, 0x2126), (0x2128, 0x212F), (0x2130, 0x2134), (0x2160, 0x217F),
    (0x2460, 0x24FF), (0x2F00, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E), (0xFF65, 0xFF9F), (0x1D400, 0x1D7FF), (0x1F100, 0x1F189),
)
INVISIBLE = (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFC))
SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
#: Combining marks that compose with the letter before them in some scripts.
MARKS = ((0x300, 0x345), (0x653, 0x655), (0x3099, 0x309A))

#: Scripts in which joiners are part of spelling, and those in which full-width signs and spaces are.
JOINING = r"[\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsArabic}\p{IsSyriac}\p{IsMongolian}]"
BREAKING = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
EASTERN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}]"


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


def _outside(pairs: dict[str, str], block: str) -> str:
    return f"[{block}&&[^{''.join(pairs)}]]"


def mapping_rows() -> list[tuple[str, str, str]]:
    """(character, what it stands for, kind), by rule from the Unicode tables of this Python."""
    rows = []
    for first, last in COMPATIBLE:
        for o in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(o))
            plain = "-" if o == 0x2011 else plain
            if plain != chr(o):
                letter = unicodedata.category(chr(o))[0] in "LN"
                rows.append((chr(o), plain, "wide_sign" if 0xFF01 <= o <= 0xFF5E and not letter else "compatible"))
    rows += [(chr(o), "", "joiner" if o in (0x200C, 0x200D) else "break" if o == 0x200B else "direction" if o in (0x200E, 0x200F, 0x61C) else "invisible") for o in INVISIBLE]
    rows += [(chr(o), " ", "wide_space" if o == 0x3000 else "fixed_space" if o in (0xA0, 0x202F) else "space") for o in SPACES]
    for kind, pairs in (("cyrillic", _pairs(CYRILLIC_TWINS)), ("greek", _pairs(GREEK_TWINS))):
        rows += [(a, b, kind) for a, b in pairs.items()]
        rows += [(b, a, f"to_{kind}") for a, b in pairs.items()]
    return rows


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _merged(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one: a short class is matched much faster."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: A character of the tables, and Latin letters beside Cyrillic or Greek ones.
OWN = "[" + _class(_merged([*COMPATIBLE, *MARKS, *[(o, o) for o in (*INVISIBLE, *SPACES, *map(ord, _pairs(CYRILLIC_TWINS)), *map(ord, _pairs(GREEK_TWINS)))]])) + "]"
MIXED = r"[A-Za-z][^\x{370}-\x{52F}]*+[\x{370}-\x{52F}]|[\x{370}-\x{52F}][^A-Za-z]*+[A-Za-z]"


def suspect(word: Column) -> Column:
    """Whether a word beyond ASCII may be out of form."""
    return word.rlike(OWN) | word.rlike(MIXED)


def _suspects(text: Column) -> Column:
    """The distinct words of a text that may be out of form. Words are cut out by a pattern that is cheap on ASCII; the tables see the rest only."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(WIDE_TOKEN), F.lit(0)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.filter(found, suspect))


def _context(text: Column) -> dict[str, Column]:
    """Whether the text has Cyrillic or Greek letters that look like no Latin one, and Latin ones."""
    c, g = _pairs(CYRILLIC_TWINS), _pairs(GREEK_TWINS)
    return {
        "cyrillic": F.when(text.rlike(r"[\x{400}-\x{52F}]"), text.rlike(_outside(c, "\\x{400}-\\x{52F}"))).otherwise(False),
        "greek": F.when(text.rlike(r"[\x{370}-\x{3FF}]"), text.rlike(_outside(g, "\\x{370}-\\x{3FF}"))).otherwise(False),
        "latin": text.rlike("[A-Za-z]{3}"),
    }


def _recompose(words: pd.Series) -> pd.Series:
    return words.map(lambda w: unicodedata.normalize("NFC", w))


def normal_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """(token, fixed, cyrillic, greek, latin): the distinct words that are out of form, by what else their text holds."""
    spark: SparkSession = df.sparkSession
    text = F.col(text_col)
    ctx = _context(text)
    words = df.where(text.isNotNull()).select(*[c.alias(k) for k, c in ctx.items()], F.explode(_suspects(text)).alias("token")).distinct()
    c, g = _pairs(CYRILLIC_TWINS), _pairs(GREEK_TWINS)
    t = F.col("token")
    own_c, own_g = t.rlike(_outside(c, "\\x{400}-\\x{52F}")), t.rlike(_outside(g, "\\x{370}-\\x{3FF}"))
    latin_twins = "".join(sorted({*c.values()}))
    has_latin = t.rlike("[A-Za-z]")
    # Letters that can only be Latin or only be Cyrillic (Greek) say what a mixed word is; without any, its text does.
    only_latin_c = t.rlike(f"[a-zA-ZÀ-ɏ&&[^{latin_twins}]]")
    only_latin_g = t.rlike(f"[a-zA-ZÀ-ɏ&&[^{''.join(sorted({*g.values()}))}]]")
    # read three times below: the texts are gone through once
    words = cut(spread(words)).withColumns({
        "_cyr": ~own_c & (only_latin_c | ~F.col("cyrillic") & F.col("latin")),
        "_grk": ~own_g & (only_latin_g | ~F.col("greek") & F.col("latin")),
        "_to_cyr": own_c & ~only_latin_c & has_latin,
        "_to_grk": own_g & ~only_latin_g & has_latin,
        "_joins": t.rlike(JOINING), "_breaks": t.rlike(BREAKING), "_eastern": t.rlike(EASTERN),
        "_rtl": t.rlike(r"[\p{IsArabic}\p{IsHebrew}]"),
        "_french": t.rlike("[\\x{A0}\\x{202F}][?!:;»%]|«[\\x{A0}\\x{202F}]"),
    })
    points = words.select("*", F.posexplode(F.split("token", "")).alias("_pos", "_ch")).where("_ch != ''")
    table = F.broadcast(spark.createDataFrame(mapping_rows(), "_ch string, _plain string, _kind string"))
    # Latin twins of both scripts have a row for either, so rows that don't apply are left out before the join's result is used
    applies = (
        F.when(F.col("_kind") == "joiner", ~F.col("_joins")).when(F.col("_kind") == "break", ~F.col("_breaks")).when(F.col("_kind") == "direction", ~F.col("_rtl"))
        .when(F.col("_kind") == "wide_sign", ~F.col("_eastern")).when(F.col("_kind") == "wide_space", ~F.col("_eastern")).when(F.col("_kind") == "fixed_space", ~F.col("_french"))
        .when(F.col("_kind") == "cyrillic", F.col("_cyr")).when(F.col("_kind") == "greek", F.col("_grk"))
        .when(F.col("_kind") == "to_cyrillic", F.col("_to_cyr")).when(F.col("_kind") == "to_greek", F.col("_to_grk"))
        .otherwise(F.lit(True))
    )
    key = ["token", "cyrillic", "greek", "latin"]
    joined = points.join(table, "_ch", "left")
    mapped = joined.groupBy(*key, "_pos").agg(F.first("_ch").alias("_ch"), F.max(F.when(F.col("_kind").isNotNull() & applies, F.struct("_plain"))).alias("_to"))
    mapped = mapped.select(*key, "_pos", F.coalesce(F.col("_to._plain"), F.col("_ch")).alias("_s"))
    # marks stay with the starter before them and are ordered by class
    single = mapped.select(*key, "_pos", F.posexplode(F.split("_s", "")).alias("_sub", "_ch")).where("_ch != ''")
    rank = F.pandas_udf(lambda s: s.map(lambda ch: unicodedata.combining(ch[0]) if ch else 0).astype("int32"), "int")
    # Unicode bounds the combining marks
    marked = single.where(F.col("_ch").rlike(r"\p{M}")).select("_ch").distinct().withColumn("_class", rank("_ch"))
    single = single.join(F.broadcast(marked), "_ch", "left").withColumn("_class", F.coalesce("_class", F.lit(0)))
    by = Window.partitionBy(*key).orderBy("_pos", "_sub")
    single = single.withColumn("_start", F.sum(F.when(F.col("_class") == 0, 1).otherwise(0)).over(by))
    built = single.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_class", "_pos", "_sub", "_ch"))), lambda x: x["_ch"]), "").alias("_built"))
    nothing = words.select(*key)
    whole = nothing.join(large(built), key, "left").withColumn("_built", F.coalesce("_built", F.lit("")))
    return whole.withColumn("fixed", F.pandas_udf(_recompose, "string")("_built")).where("fixed != token").select(*key, "fixed")


def one_form(df: DataFrame, text_col: str, out: str = "normal_text") -> DataFrame:
    """Every row of df with `out`, its text in the consistent form, and `out_of_form`; columns of those names are replaced.

    What is normal in a text's own language stays: joiners in Indic and Arabic words, full-width signs and spaces among Chinese and
    Japanese, fixed spaces before French marks, ordinary quotes, dashes and signs. Null stays null.
    """
    base = df.drop(*[c for c in (out, "out_of_form") if c != text_col])
    done = rewrite(base, text_col, normal_tokens(base, text_col), out, WIDE_TOKEN, _context(F.col(text_col)), suspect)
    return done.withColumn("out_of_form", F.col(f"{out}_hits").isNotNull()).drop(f"{out}_hits")
