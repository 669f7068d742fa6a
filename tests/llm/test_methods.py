"""What each operator finds, against brute force, round trips and held-out accuracy."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import canonical, encoding, forms, mixing, packing, quality, queries, repeated_lines, repetition, scans, sentences
from foliomill.llm.checked import JUNK, PROSE

DIR = "/root/testdata/sf0.01"
WORDS = "the plant tested a pump near river while margins held steady and lenders took note of every report from our mill".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- 1
@pytest.mark.parametrize(
    ("right", "wrong"),
    [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")],
)
def test_exact_check_undoes_each_chain(right, wrong):
    for word in ("société", "für", "company’s", "Vorräte", "“Naïve", "₹45.3", "комитета", "εργοστάσιο"):
        assert encoding.undo(encoding.read_as(word.encode(right), wrong)) == word


def test_double_and_eastern_chains():
    twice = encoding.read_as(encoding.read_as("crédito".encode(), "cp1252").encode(), "cp1252")
    assert encoding.undo(twice) == "crédito"
    assert encoding.undo(encoding.read_as("受注の増加を受けて".encode("shift_jis"), "cp1252")) == "受注の増加を受けて"


@pytest.mark.parametrize("word", ["l’été", "d’énergie", "“Naïve", "café,", "Øre", "Übernahme", "комитет", "Рёв", "ＨＵＭＡＮ", "了。", "–", "•", "№", "procurеment", "[caf", "été!", "§¤¬°*#<"])
def test_clean_words_are_left_alone(word):
    assert encoding.undo(word) is None


def test_words_are_looked_up_in_the_corpus(spark):
    rows = [(1, "Un café modernisé près de la sécheresse."), (2, "Un caf� modernis� pr�s"), (3, "Un cafй modernisй"), (4, "plain text"), (5, "Zwölf")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: (r["garbled"], r["repaired_text"]) for r in encoding.repair_encoding(df, "t").collect()}
    assert got[1] == (False, rows[0][1]) and got[4][0] is False and got[5][0] is False
    assert got[2] == (True, "Un café modernisé près") and got[3] == (True, "Un café modernisé")


def test_forms_of_plain_letters_are_looked_up(spark):
    good = [(i, "Во втором полугодии завод в районе закрыл сеть продаж. El año señor terminó. Το εργοστάσιο αγόρασε.") for i in range(25)]
    read = lambda x, right, wrong: x.encode(right).decode(wrong)
    bad = [
        (100, read("Во втором полугодии завод Зангунд в районе.", "koi8-r", "cp1251") + " Завод в районе."), (101, read("Завод", "cp1251", "koi8-r") + " «" + read("закрыл", "cp1251", "koi8-r") + "»."),
        (102, "El " + read("año", "cp1252", "cp1250") + " terminó."), (103, read("εργοστάσιο αγόρασε", "cp1253", "cp1251")), (104, "Во втором районе."), (105, "ЗАО и НДС, ОБ ИТОГАХ. кВт"),
    ]
    df = spark.createDataFrame(good + bad, "i int, t string")
    got = {r["i"]: (r["garbled"], r["repaired_text"]) for r in encoding.repair_encoding(df, "t").collect()}
    assert got[100] == (True, "Во втором полугодии завод Зангунд в районе. Завод в районе.")
    assert got[101] == (True, "Завод «закрыл».")
    assert got[102] == (True, "El año terminó.") and got[103] == (True, "εργοστάσιο αγόρασε")
    assert not got[0][0] and not got[104][0] and not got[105][0]
    same = {r["i"]: r["t"] for r in encoding.repair_encoding(df, "t", "t").collect()}
    assert same[100] == got[100][1] and same[0] == good[0][1]


def test_the_table_finds_without_the_check(spark, monkeypatch):
    words = ["société", "für", "Vorräte", "комитета", "εργοστάσιο", "計画"]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")]
    good = [(i, "La société für Vorräte, комитета и εργοστάσιο 計画.") for i in range(20)]
    bad = [(100 + k, encoding.read_as(w.encode(r), c)) for k, (w, (r, c)) in enumerate((w, c) for w in words for c in chains)]
    df = spark.createDataFrame(good + bad, "i int, t string")
    found = {r["token"]: (r["fixed"], r["way"]) for r in encoding.garbled_tokens(df, "t").collect()}
    for k, (w, _) in enumerate((w, c) for w in words for c in chains):
        assert found[bad[k][1]] == (w, "TABLE")


def test_passages_longer_than_a_word_are_looked_up_by_letters(spark):
    long = "今年的需求会回升吗我们批准了信用管理规则并完成了污水处理项目" * 4
    garbled = encoding.read_as(long[::-1].encode(), "cp1252")
    df = spark.createDataFrame([(1, long), (2, garbled), (3, "plain")], "i int, t string")
    got = {r["token"]: (r["fixed"], r["way"]) for r in encoding.garbled_tokens(df, "t").collect()}
    assert len(long) > encoding.LONG and got == {garbled: (long[::-1], "TABLE")}


def test_words_of_a_corpus_repair_some_rows(spark):
    corpus = spark.createDataFrame([(i, "La société est là.") for i in range(9)] + [(50, "Une soci� ici")], "i int, t string")
    rows = corpus.where("i = 50")
    assert encoding.repair_encoding(rows, "t", corpus=corpus).collect()[0]["garbled"]


# --- 2
def test_words_beside_a_boundary_are_whole():
    word = "x" * 100
    assert sentences.before(word + ". Next", 101) == word + "." and sentences.after("a. " + word, 2) == word
    assert sentences.after("a." + " " * 60 + "Hello, x", 2) == "Hello" and sentences.before("a b" + " " * 70, 73) == "b"


def test_sentence_model_on_held_out_text(spark):
    r = random.Random(1)
    names = ["Mr. Smith", "Dr. Jones", "Prof. Lee"]

    def one():
        k = r.randrange(6)
        return [f"The works at {r.choice(['Alby', 'Corund', 'Tirhus'])} grew by approx. {r.random() * 9:.1f} per cent.", f"{r.choice(names)} visited the mill.", "“Is it ready?” asked the engineer.", "Will demand recover next year?", "Exports to the U.S. and others rose.", "今年的需求会回升吗？"][k]

    units, truth = [], []
    for i in range(900):
        parts = [one() for _ in range(r.randint(1, 5))]
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
            at += 1
        units.append((i, " ".join(parts)))
        truth.append(ends)
    train = spark.createDataFrame(units[:600], "i int, t string")
    model = sentences.fit(train, "t")
    wrong = sum(model.ends_of(t) != e for (_, t), e in zip(units[600:], truth[600:]))
    assert wrong <= 3
    df = spark.createDataFrame(units[600:610], "i int, t string")
    got = sentences.sentences(df, "i", "t", model).orderBy("i", "sentence_number").collect()
    assert "".join(x["sentence_text"] + " " for x in got if x["i"] == units[600][0]).strip() == units[600][1]


def test_sentence_counts_come_from_all_units(spark, tmp_path, monkeypatch):
    rows = [("a", "PARAGRAPH", "native", "The plant grew. It rose."), ("b", "PARAGRAPH", "native", "The plant\ngrew."), ("c", "SECTION_HEADING", "native", "Outlook"), ("d", "PARAGRAPH", "ocr", "Margins held.")]
    spark.createDataFrame(rows, "paragraph_id string, unit_type string, text_source string, paragraph_text string").write.parquet(f"{tmp_path}/mda_paragraph_level.parquet")
    seen, fit = [], sentences.fit
    monkeypatch.setattr(sentences, "fit", lambda df, *a, **k: seen.append({r["paragraph_text"] for r in df.collect()}) or fit(df, *a, **k))
    queries.p2_found(spark, str(tmp_path))
    assert seen == [{t for *_, t in rows}]


# --- 3
def test_statistics_and_kinds(spark):
    # texts that are held out decide: with a table of real size, and with the seed alone
    held, n = [*quality.HELD[0], *quality.HELD[1]], len(quality.HELD[0])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "i int, t string")
    units = f"{DIR}/mda_paragraph_level.parquet"
    for train, least in ((df.limit(0), 0.8), (spark.read.parquet(units).withColumnRenamed("paragraph_text", "t") if os.path.exists(units) else None, 0.95)):
        if train is None:
            continue
        common = quality.common_words(train, "t")
        got = {r["i"]: r["text_kind"] for r in quality.text_quality(df, "t", quality.fit(train, "t", common), common).collect()}
        right = sum(got[i] == ("PROSE" if i < n else "STRUCTURE") for i in got)
        assert right >= least * len(held), (right, len(held))
    s = quality.statistics(["One two. Three!\nlist item", ""], frozenset(), frozenset())
    v = dict(zip(quality.NAMES, s[0]))
    assert (v["n_words"], v["n_lines"], v["sentence_ends"], v["lines_ended_share"]) == (5, 2, 2, 0.5)
    assert not s[1].any()


def test_held_out_texts_are_never_learned_from(spark, monkeypatch):
    seen = []
    real = quality.statistics
    monkeypatch.setattr(quality, "statistics", lambda texts, *a: seen.append(list(texts)) or real(texts, *a))
    held = [*quality.HELD[0], *quality.HELD[1]]
    quality.fit(spark.createDataFrame([(t,) for t in [*held, "Another text stands here."]], "t string"), "t", ["the"])
    assert seen == [[*quality.SEED[0], *quality.SEED[1]], held, ["Another text stands here."]]


# --- 4
def test_line_model_labels_more_than_a_pattern():
    def wrapped(seed, n=60, width=52):
        lines, line = [], ""
        for w in (text(seed, n).capitalize() + ".").split():
            if len(line) + 1 + len(w) > width:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return [*lines, line]

    titles = ["Acme Mills Limited Annual Report 2019-20", "Acme Mills Limited", "Sustainability Review", "34", "Page 12 of 90", "ACME MILLS LIMITED | 77"]
    r, texts, truth = random.Random(4), [], []
    for i in range(600):
        lines, at = wrapped(i), None
        if i % 3 == 0:
            at = r.randrange(1, len(lines) - 1)
            lines.insert(at, r.choice(titles))
        elif i % 3 == 1:
            lines += ["1998"]  # looks like the number of a page, and ends a table
        texts.append("\n".join(lines))
        truth.append(at)
    model = scans.Lines().fit(texts[:400])
    score = {"model": [0, 0, 0], "pattern": [0, 0, 0]}
    for t, at in zip(texts[400:], truth[400:]):
        f = scans.line_features(t.split("\n"))
        for name, found in (("model", set(np.flatnonzero(model.label(f) == scans.HEADER).tolist())), ("pattern", set(np.flatnonzero(f[:, scans.KIND] > 0).tolist()))):
            want = set() if at is None else {at}
            score[name] = [a + b for a, b in zip(score[name], (len(found & want), len(found - want), len(want - found)))]
    f1 = {k: 2 * a / (2 * a + b + c) for k, (a, b, c) in score.items()}
    assert f1["model"] > 0.97 > 0.8 > f1["pattern"]


def test_breaks_end_paragraphs(spark):
    one = ["The plant tested the pump near the river while the", "margins held steady and the lenders took note. It", "was good.", "Every report from our mill said that the plant held", "the pump steady near the river."]
    rows = [(i, "\n".join(one)) for i in range(40)]
    got = scans.repair_scans(spark.createDataFrame(rows, "i int, t string"), "t").first()["readable_text"]
    assert got == " ".join(one[:3]) + "\n" + " ".join(one[3:])


def test_long_words_meet_known_ones(spark):
    word = "donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbau"
    seen = word.replace("m", "rn", 1).replace("w", "vv", 1)
    rows = [(i, f"Die {word} stand.") for i in range(60)] + [(100, f"Die {seen} stand."), (101, f"Die {word}die stand."), (102, "Die " + "ab" * 4000 + " stand.")]
    got = {r["i"]: (r["scan_damage"], r["readable_text"]) for r in scans.repair_scans(spark.createDataFrame(rows, "i int, t string"), "t").where("i >= 100").collect()}
    assert len(word) > scans.SHORT and got[100] == (["misread"], f"Die {word} stand.") and got[102][0] == []
    assert scans.reaches(seen, word) and not scans.reaches(seen, word, 1) and not scans.reaches("abc", "abd")
    assert scans.cuts("x" * 200, frozenset()) == [] and scans.cuts("x" * 200, frozenset({190})) == [10, 190]


@given(st.lists(st.sampled_from("abcdefgh"), min_size=41, max_size=60), st.integers(0, 40), st.integers(0, 40), st.sampled_from(scans.MISREAD), st.sampled_from(scans.MISREAD))
@settings(max_examples=80, deadline=None)
def test_words_of_two_misread_places_share_a_segment(letters, i, j, a, b):
    original = "".join(letters)
    i, j = sorted((i, j))
    word = original[:i] + a[1] + original[i:j] + b[1] + original[j:]
    seen = original[:i] + a[0] + original[i:j] + b[0] + original[j:]
    known = set(scans._segments(word, len(word), range(1)))
    assert known & set(scans._segments(seen, len(word), range(-2, 3)))


# --- 4, repairs
def test_scan_damage(spark):
    base = [(i, f"The supply contract for the mill was tested by the plant number {i}.\nThe report says that the low-cost supply was steady.") for i in range(60)]
    bad = [
        (1000, "The supply cont-\nract was tested by tbe plant for the mill."), (1001, "The s u p p l y was steady and the plant says so."), (1002, "The supply was ~ steady and the |_ plant says so."),
        (1003, "The supply contract was tested\nAcme Mills Limited Annual Report 2019-20 | 34\nby the plant for the mill."), (1004, "The low-\ncost supply was steady."), (1005, "The supplycontract was steady."), (1006, "Plain text stays."), (1007, "The supp1y was steady."),
    ]
    df = spark.createDataFrame(base + bad, "i int, t string")
    got = {r["i"]: (set(r["scan_damage"]), r["readable_text"]) for r in scans.repair_scans(df, "t").where("i >= 1000 or i = 3").collect()}
    assert got[3][0] == set() and got[1006] == (set(), "Plain text stays.")
    assert got[1000] == ({"divided", "misread"}, "The supply contract was tested by the plant for the mill.")
    assert got[1001] == ({"spread"}, "The supply was steady and the plant says so.") and got[1002] == ({"stray"}, "The supply was steady and the plant says so.")
    assert got[1003] == ({"header"}, "The supply contract was tested by the plant for the mill.")
    assert got[1004] == (set(), "The low-cost supply was steady.")
    assert got[1005] == ({"joined"}, "The supply contract was steady.") and got[1007] == ({"misread"}, "The supply was steady.")


def test_rare_originals_explain_damage(spark):
    rows = [(i, f"The unit reports to the plant number {i}.") for i in range(120)] + [(200 + i, f"Praquinewadi and Ilvmorawadi {i} rose.") for i in range(8)] + [(300 + i, "Ashes were casing.") for i in range(4)]
    bad = [(1000, "Near Praquinevvadi it rose."), (1001, "The Ilvmorawadiunit rose."), (1002, "Near Pr@quinewadi it rose."), (1003, "Ashes were easing."), (1004, "Ashes were easing it."), (1005, "Praquinewadis"), (1006, "Ashesunit"), (1007, "Near |lvmorawadi it rose.")]
    got = {r["i"]: (r["scan_damage"], r["readable_text"]) for r in scans.repair_scans(spark.createDataFrame(rows + bad, "i int, t string"), "t").collect()}
    assert got[1000] == (["misread"], "Near Praquinewadi it rose.") and got[1002] == (["misread"], "Near Praquinewadi it rose.")
    assert got[1001] == (["joined"], "The Ilvmorawadi unit rose.") and got[1007] == (["misread"], "Near Ilvmorawadi it rose.")
    assert all(got[i] == ([], t) for i, t in bad[3:7]) and got[200][0] == [] and got[300][0] == []


# --- 5
def test_repeated_lines_against_brute_force(spark):
    r = random.Random(3)
    notices = ["Subscribe to member alerts today", "© Acme – all rights reserved", "short one", "Ask for the printed copy now"]
    rows = []
    for i in range(400):
        lines = [text(i * 7 + k, 9) for k in range(2)]
        if r.random() < 0.3:
            n = r.choice(notices)
            lines.insert(r.randrange(3), n.upper() if r.random() < 0.3 else n)
        rows.append((f"p{i}", "hot" if i % 3 else f"s{i % 5}", "\n".join(lines)))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = {(x["id"], x["line_no"]) for x in repeated_lines.repeated_lines(df, "id", "source", "text").collect()}
    key = lambda s: "".join(c for c in s.lower() if c.isalpha())
    per, total, places = defaultdict(set), defaultdict(set), set()
    for i, s, t in rows:
        total[s].add(i)
        for line in t.split("\n"):
            per[s, key(line)].add(i)
    for i, s, t in rows:
        for n, line in enumerate(t.split("\n"), 1):
            k = key(line)
            if len(k) >= 12 and len(per[s, k]) >= max(5, 0.015 * len(total[s])):
                places.add((i, n))
    assert got == places and places
    clean = {x["id"]: x["clean_text"] for x in repeated_lines.without_repeated_lines(df, "id", "source", "text").collect()}
    i, n = next(iter(places))
    assert len(clean[i].split("\n")) == len(next(t for a, _, t in rows if a == i).split("\n")) - sum(a == i for a, _ in places)


def test_chunks_depend_on_the_line_alone():
    line = "subscribetomemberalertsfromacmeindustriestoday"
    alone = repeated_lines.chunks([line])[2]
    of, _, among, _ = repeated_lines.chunks(["other words here", line, "more"])
    assert (among[of == 1] == alone).all() and len(alone) > 1


def test_chunks_of_unbroken_text_are_cut(spark):
    notice = "Please subscribe to the alerts of Acme Industries and read the caution on the last page of the report"
    rows = [(f"p{i}", "s", text(i, 12) + " " + notice + " " + text(i + 999, 12)) for i in range(12)] + [(f"q{i}", "s", text(5000 + i, 20)) for i in range(200)] + [(None, "s", notice), ("n", "s", None), ("o", None, notice)]
    got = {r["id"]: r for r in repeated_lines.without_repeated_chunks(spark.createDataFrame(rows, "id string, source string, text string"), "id", "source", "text").collect()}
    for i in range(12):
        r = got[f"p{i}"]
        assert r["chunks_cut"] > 0 and "caution" not in r["clean_text"] and len(r["text"]) - len(r["clean_text"]) > 0.4 * len(notice)
        assert r["clean_text"].startswith(text(i, 12)[:30]) and r["clean_text"].endswith(text(i + 999, 12)[-30:])
    assert got["n"]["clean_text"] is None and got["o"]["clean_text"] == notice and got[None]["clean_text"] == notice and got["o"]["chunks_cut"] == 0


# --- 6
@pytest.mark.parametrize(
    ("seen", "plain"),
    [
        ("ｐｏｒｔ", "port"), ("ﬁrm", "firm"), ("Café", "Café"), ("a​b", "ab"), ("in­put", "input"), ("of the", "of the"), ("Моgskаr", "Mogskar"), ("crοre", "crore"), ("𝐓𝐞𝐚𝐦", "Team"), ("lost‑time", "lost-time"),
        ("売上﻿高", "売上高"), ("пpoдaл", "продал"), ("が", "が"), ("ẹ́", "ẹ́"), ("ẹ́", "ẹ́"),
    ],
)
def test_one_form(spark, seen, plain):
    rows = [(1, f"word {seen} end words"), (2, "word plain")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: (r["out_of_form"], r["normal_text"]) for r in forms.one_form(df, "t").collect()}
    assert got == {1: (True, f"word {plain} end words"), 2: (False, "word plain")}


@pytest.mark.parametrize("ok", ["पर्‍यावरण", "“quoted” – dash…", "安全第一！是吗？", "№ 5 ™ ½", "комитет со сном", "Ну а что", "Θα το δω", "vente ?", "café"])
def test_what_is_normal_stays(spark, ok):
    df = spark.createDataFrame([(1, ok)], "i int, t string")
    r = forms.one_form(df, "t").collect()[0]
    assert not r["out_of_form"] and r["normal_text"] == ok


# --- 7
def test_headings(spark):
    entries = [("MDA", "Management Discussion & Analysis"), ("CSR", "Corporate Social Responsibility"), ("CSR", "CSR Report"), ("RISK", "Risk Management"), ("BRR", "BRR"), ("BRSR", "BRSR"), ("BOARD", "Board's Report"), ("CHAIR", "Letter from the Chairman"), ("SEC", "Secretarial Audit Report")]
    cases = {
        "mgmnt disc. & analysis": "MDA", "Management Discussion & An": "MDA", "C o r p o r a t e  S o c i a l  R e s p o n s i b i l i t y": "CSR", "CSR Rcport": "CSR", "7.2 Risk Managment (contd.)": "RISK", "BRR – Acme Holdings Limited": "BRR", "brsr": "BRSR",
        "Boadr's Reprt": "BOARD", "Extract of the Letter from the Chairman": "CHAIR", "Sec'l Audit Report 2019-20": "SEC", "Canteen Management and Meal Discussion": "UNMATCHED", "Board and Lodging at Alby": "UNMATCHED", "Photo Feature": "UNMATCHED", "": "UNMATCHED",
    }
    df = spark.createDataFrame([(k, "x") for k in cases], "h string, token string")
    got = {r["h"]: r["category_code"] for r in canonical.canonical(df, "h", entries).collect()}
    assert got == cases


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=150, deadline=None)
def test_distance(a, b):
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    assert canonical.distance(a, b, 3) == min(slow(a, b), 4)


# --- 8
@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    totals = [sum(sizes[i] for i in b) for b in bins]
    assert all(t <= 50 for t in totals) and sum(t <= 25 for t in totals) <= 1


def test_packing_is_whole_and_tight(spark):
    df = spark.createDataFrame([(i, text(i, 1 + i % 90)) for i in range(1500)] + [(9999, text(1, 1200))], "i int, t string").repartition(9)
    out = packing.pack(df, "i", "t", [("small", 64), ("large", 512)]).toPandas()
    for kind, capacity in (("small", 64), ("large", 512)):
        k = out[out.container_kind == kind]
        fill = k.groupby("container_id").tokens.sum()
        assert fill.max() <= capacity and set(k.i) == set(range(1500)) | {9999}
        assert fill.sum() / (len(fill) * capacity) > 0.98
        whole = k.groupby("i").tokens.agg(["sum", "count"])
        assert (whole[whole["sum"] <= capacity]["count"] == 1).all()
    n = out[out.i == 9999].groupby("container_kind").tokens.sum()
    assert n.nunique() == 1


def test_large_items_do_not_gather_in_one_task(spark):
    sizes = [(51 + i % 48, []) for i in range(5000)]
    done, left = packing.residual([(t, []) for t, _ in sizes] + [(20, [])], 100, 0.995, 64)
    assert len(left) == 65 and len(done) + len(left) == 5001 and max(t for t, _ in left) <= min(t for t, _ in done)
    df = spark.createDataFrame([(i, text(i, 40 + i % 20)) for i in range(3000)] + [(i, "one") for i in (7001, 7001, 7002)], "i int, t string")
    out = packing.pack(df, "i", "t", [("k", 64)], items=100, carry=4).toPandas()
    fill = out.groupby("container_id").tokens.sum()
    assert fill.max() <= 64 and len(out) == 3003 and (out.groupby("i").size().loc[[7001, 7002]] == [2, 1]).all()


# --- 9
def test_mixture_meets_shares(spark):
    rows = [(i, s, text(i, 20 + i % 30)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["low"] * 120 + ["none"] * 50)]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.25, 2), ("low", 0.1, 3), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    counts = mixing.sized(df, "i", "t", "s")
    plan = mixing.planned(counts, targets)
    got = {r["source"]: r for r in mixing.shares(counts, plan, "i").collect()}
    for s, w in (("big", 0.6), ("mid", 0.25), ("low", 0.1)):
        assert abs(got[s]["actual_share"] - w / 0.95) < 0.005
        assert got[s]["repeats_used"] <= got[s]["max_repeats"]
    m = mixing.mixture(counts, plan, "i").toPandas()
    assert m.position.is_monotonic_increasing and not m.duplicated(["i", "repeat_no"]).any() and set(m.source) == {"big", "mid", "low"}
    early = m[m.position < 0.5].groupby("source").tokens.sum()
    late = m[m.position >= 0.5].groupby("source").tokens.sum()
    assert early["big"] / early.sum() > late["big"] / late.sum()  # the schedule turns to repeated sources


# --- 10
def brute(words, size):
    seen, hit = set(), set()
    for i in range(len(words) - size + 1):
        g = tuple(words[i : i + size])
        if g in seen:
            hit |= set(range(i, i + size))
        seen.add(g)
    return len(hit)


def test_repetition_against_brute_force(spark):
    rows = []
    for i in range(120):
        r = random.Random(i)
        base = text(i, r.randint(0, 120))
        rows.append((i, base + (" " + base[: r.randint(0, len(base))] if i % 3 else "") + (" 12, 34. dossier," * 20 if i % 5 == 0 else "")))
    rows.append((500, "計画" * 200 + "受注の増加を受けて当社は与信の規則を簡素化しました"))
    rows.append((501, "One two three four five six seven EIGHT. 5.5 one two THREE four, five six seven eight"))
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: r for r in repetition.repetition(df, "i", "t").collect()}
    for i, t in rows:
        if i == 500:
            w, size = [c for c in t if c.isalpha()], 16
        else:
            w, size = re.findall(r"[^\W\d_]+", t.lower()), 8
        want = brute(w, size)
        assert got[i]["units"] == len(w) and got[i]["repeated_units"] == want
        assert got[i]["band"] == "REPETITIVE" or want < 0.3 * len(w)
    assert got[501]["repeated_share"] == 0.5
    some = {r["i"]: r for r in repetition.repetition(df, "i", "t", every=False).collect()}
    assert all(some[i]["repeated_units"] == (got[i]["repeated_units"] if got[i]["band"] == "REPETITIVE" else 0) for i, _ in rows)


def test_bands_hold_every_text_of_three_tenths_and_few_others():
    r = np.random.default_rng(0)
    small = repetition._compressor(0)
    for k in range(400):
        n, w = int(r.choice([16, 26, 40, 80, 160, 400, 3000])), int(r.choice([8, 16]))
        fresh = r.integers(0, 1 << 24, max(w, n)).tolist()
        units = list(fresh)
        while len(units) * 0.3 > len(units) - len(fresh):
            at = int(r.integers(0, len(fresh) - w + 1))
            units += fresh[at : at + w]
        pack = lambda u: np.array(u, "<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        assert repetition.band(pack(units), b"x" * 100, small)[3] == "REPETITIVE"
        assert repetition.band(pack(fresh), b"x" * 100, small)[3] != "REPETITIVE"
    noise = r.integers(0, 256, 5000).astype(np.uint8).tobytes()
    assert repetition.band(b"", noise, small)[3] == "INCOMPRESSIBLE"
    assert repetition.band(b"", text(1, 900).encode(), small)[3] == "PLAIN"


def test_windows_of_many_lists_at_once():
    r = np.random.default_rng(5)
    lists = [r.integers(0, 3, n) for n in (0, 5, 40, 8, 100)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = repetition.repeated_units(np.concatenate(lists), off, np.array([8, 8, 8, 16, 16]))
    assert got.tolist() == [brute(x.tolist(), k) for x, k in zip(lists, (8, 8, 8, 16, 16))]
