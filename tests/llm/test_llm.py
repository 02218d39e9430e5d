"""Small tests of the corpus operators: nulls, blanks, ties, repeats, empty tables, brute force."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import boilerplate_lines as B, main_content as M, mixing, names, near_duplicates as N, packing, pair_defects as D, sentences as S, split_overlap as O, splitting, tokens

WORDS = [f"word{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 1
@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("Why?", None, ["empty"]), ("Why?", " \n", ["empty"]), ("Why?", "<answer></answer>", ["empty"]), ("Find edges.", "(none)", []),
        ("How long would it last?", "12 days", []), ("Tell me about the plant in the north.", "The plant was closed after the", ["truncated"]),
        ("Give one JSON event.", '{"a": 1, "b": "x', ["truncated"]), ("Give one JSON event.", '{"a": 1}', []),
        ("What is the share of Acme?", "I'm sorry, but I can't help with that request.", ["refusal"]),
        ("What is the share?", "The passage does not name a second supplier.", []),
        ("From whom does Acme obtain its ball valves?", "from whom does acme obtain its ball valves?", ["copy"]),
        ("Translate the key message into French:\nAcme buys parts.", "Acme achète des pièces auprès de la société et la part est de dix pour cent.", []),
        ("Translate the key message into French:\nAcme buys parts from the firm.", "Acme buys the parts from its supplier and that is all.", ["language"]),
    ],
)
def test_defects(prompt, answer, want):
    assert D.defects(D.Prompt(prompt), answer) == want


def test_a_long_refusal_is_one_and_a_long_answer_is_not():
    pad = " ".join(f"The point number {i} is set out in the notes." for i in range(60))
    assert "refusal" in D.defects(D.Prompt("Why?"), "I'm sorry, but I can't help with that request. " + pad)
    assert D.defects(D.Prompt("Why?"), pad + " The bank said it cannot lend. " + pad) == []


def test_list_endings_are_learned_from_all_answers(spark):
    rows = [(i, "List the three main exposures.", f"1. price of steel\n2. only {i} days of cover\n3. share held by Acme") for i in range(40)]
    rows += [(90, "List the three main exposures.", "1. price of steel\n2. share held by Acme\n3. only 7 days of"), (91, "List the three main exposures.", "1. price of steel\n2. share held by Acme\n3. only 7 days"), (92, "List the three main exposures.", "1. price of steel\n2. share held by Acme\n3. only 7 days of cov")]
    df = spark.createDataFrame(rows, "record_no long, prompt string, chosen string")
    assert {(r.record_no, r.defect) for r in D.find_defects(df, "t", ["chosen"]).collect()} == {(90, "truncated"), (91, "truncated"), (92, "truncated")}


def test_languages_beyond_the_tables(spark):
    finnish = "Yhtiö ei ole vielä ilmoittanut, että se olisi muuttanut suunnitelmaa, mutta hän sanoi sen olevan mahdollista."
    assert D.defects(D.Prompt("What does the passage say about the plan? It is in the report of the firm."), finnish) == ["language"]


def test_defect_table(spark):
    df = spark.createDataFrame([(1, None, None, "x")], "record_no long, prompt string, chosen string, rank string")
    assert [(r.field, r.defect) for r in D.find_defects(df, "t", ["chosen"]).collect()] == [("chosen", "empty")]
    assert D.find_defects(df.limit(0), "t", ["chosen"]).count() == 0


# 2
def test_repeated_lines(spark):
    sites = spark.createDataFrame([("a.example", "A")], "domain string, provider string")
    rows = [(i, f"Body {'xyz'[i % 3]} {i}\r\n\r\nFollow us 12\nFollow  US 9", "https://m.A.example:80/x?q", None) for i in range(6)]
    rows += [(7, "Follow us 1", None, "A"), (8, "Follow us 1", "urn:x", "B"), (9, None, None, "A")]
    df = spark.createDataFrame(rows, "id long, raw_text string, source_url string, provider string")
    got = {tuple(r) for r in B.repeated_line_positions(df, sites).collect()}
    assert got == {(i, n) for i in range(6) for n in (3, 4)} | {(7, 1)}
    clean = {r.id: r for r in B.strip_repeated_lines(df, sites).collect()}
    assert clean[0].clean_text == "Body x 0\r\n\r" and clean[0].removed == 2 and clean[8].clean_text == "Follow us 1" and clean[9].clean_text is None
    assert B.repeated_line_positions(df.limit(0), sites).count() == 0


def test_lines_are_decided_without_the_statistics(spark, monkeypatch):
    sites = spark.createDataFrame([("a.example", "A"), ("b.example", "B")], "domain string, provider string")
    rows = [(i, f"Body {'xyzuvw'[i % 6]}{'abcd'[i // 6]}\nShared" + ("\nFollow us" if i % 2 else ""), None, "AB"[i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, raw_text string, source_url string, provider string")
    want = {tuple(r) for r in B.excessive_lines(df, sites).select("site", "h").collect()}
    monkeypatch.setattr(B, "log_likelihood_ratio", lambda *_: pytest.fail("not needed"))
    assert {tuple(r) for r in B.flat_hot(df, sites, 5, 0.10).collect()} == want and len(want) == 3
    assert {tuple(r) for r in B.repeated_line_positions(df, sites).collect()} == {(i, 2) for i in range(24)} | {(i, 3) for i in range(1, 24, 2)}


# 3
def test_pieces_cover_overlap_and_limit():
    rng = random.Random(1)
    body = "\n\n".join(". ".join(text(rng, 15) for _ in range(rng.randint(1, 9))) + "." for _ in range(60))
    for t in (body, "x" * 20_000, "a " * 9_000, "。".join("漢字" * 30 for _ in range(300))):
        ps = splitting.pieces_of(t)
        assert ps[0][0] == 0 and ps[-1][1] == len(t) and len(ps) > 1
        assert all(z <= splitting.LIMIT and z == splitting.size_of(len(t[a:b].split()), b - a) for a, b, z, _ in ps)
        for (a, b, *_), (c, e, *_) in zip(ps, ps[1:]):
            assert a < c <= b < e and 100 <= splitting.size_of(len(t[c:b].split()), b - c) <= 260
    assert splitting.pieces_of("short") == [(0, 5, 2, "end")] and splitting.pieces_of("") == [(0, 0, 0, "end")]


def test_split_table(spark):
    df = spark.createDataFrame([("a", "w " * 3000), ("a", "w " * 3000), ("b", None), ("c", "")], "chunk_id string, text string")
    out = splitting.split_texts(df).collect()
    assert {r.chunk_id for r in out} == {"a", "c"} and len([r for r in out if r.chunk_id == "a"]) == len(splitting.pieces_of("w " * 3000))


# 4
def test_name_variants(spark):
    firm = ["Zebtoria Rail Equipment LLC", "ZEBTORIA RAIL EQUIPMENT LLC", "ZebtoriaRailEquipment", "Rail Equipment, Zebtoria LLC", "Zebtoria Rail Equpment", "Zebtoria"]
    other = ["Quelmira Rail Equipment Inc.", "Quelmira Rail Equipment Incorporated", "Vandelay Copper Mining AG", "Ostrava Copper Mining AG"]
    people = ["Charles Mendelberg", "Chuck Mendelberg", "Mendelberg, Charles", "C. Mendelberg"]
    filler = [f"{a}{b} {c} Inc." for a in ("Aur", "Cyr", "Ell", "Ith", "Jes", "Yel") for b in ("donex", "ravia", "mitas", "quill") for c in ("Rail Equipment", "Copper Mining")]
    rows = [(n, False, n in firm[:1] + other) for n in firm + other + filler] + [(n, True, False) for n in people] + [(None, False, False), (" ", True, False)]
    got = {r.name: r.entity for r in names.link_names(spark.createDataFrame(rows, "name string, person boolean, official boolean")).collect()}
    assert len({got[n] for n in firm}) == 1 and len({got[n] for n in people}) == 1
    assert got[other[0]] == got[other[1]] != got[firm[0]] and got[other[2]] != got[other[3]]
    assert names.collision(0.54, names.BANDS) > 0.97 and names.collision((names.LONGEST - 7) / (names.LONGEST + 5), names.BANDS) >= names.RECALL


def test_initials_join_though_the_given_name_is_the_core(spark):
    full = ["Tariq Aurtoberg", "Aurtoberg, Tariq", "TARIQ AURTOBERG", "Tariq Belmonte", "Belmonte, Tariq", "Tariq Corvinus", "Corvinus, Tariq"]
    rows = [(n, True, False) for n in [*full, "T. Aurtoberg", "T. Belmonte", "X. Belmonte", "Mats Dovrefjell", "Mona Dovrefjell", "M. Dovrefjell", "Tariq"]]
    got = {r.name: r.entity for r in names.link_names(spark.createDataFrame(rows, "name string, person boolean, official boolean")).collect()}
    assert got["T. Aurtoberg"] == got["Tariq Aurtoberg"] != got["T. Belmonte"] == got["Tariq Belmonte"]
    assert got["X. Belmonte"] != got["Tariq Belmonte"] and got["M. Dovrefjell"] == "alone:M. Dovrefjell" and got["Tariq"] == "alone:Tariq"


def test_a_misspelt_common_word_is_no_identity_however_often_it_stands(spark):
    rng = random.Random(3)
    last = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(30)]
    firm = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(30)]
    people = [f"Anthony {x}" for x in last] + [f"{x}, Anthony" for x in last] + [f"Atnhony {x}" for x in last[:6]]
    firms = [f"{x} Semiconductor Freight" for x in firm] + [f"{x} Semicodnutor Freight Inc." for x in firm[:6]]
    df = spark.createDataFrame([(n, n in people, False) for n in people + firms], "name string, person boolean, official boolean")
    got = {r.name: r.entity for r in names.link_names(df).collect()}
    assert all(got[f"Atnhony {x}"] == got[f"Anthony {x}"] == got[f"{x}, Anthony"] for x in last[:6])
    assert all(got[f"{x} Semicodnutor Freight Inc."] == got[f"{x} Semiconductor Freight"] for x in firm[:6])
    assert len(set(got.values())) == 60


def test_names_of_every_script_come_out(spark):
    rows = ["Łukasz Wiśniewski", "Lukasz Wisniewski", "Großmann Optik GmbH", "Grossmann Optik", "Ørsted Wind", "Orsted Wind", "株式会社日立製作所", "日立製作所", "Газпром нефть", "газпром нефть", "شركة النور", "...", "\u200b"]
    df = spark.createDataFrame([(n, n.endswith("iewski"), False) for n in rows], "name string, person boolean, official boolean")
    got = {r.name: r.entity for r in names.link_names(df).collect()}
    assert set(got) == set(rows)
    assert all(got[a] == got[b] for a, b in (rows[:2], rows[2:4], rows[4:6], rows[8:10])) and got["..."] == "alone:..."


def test_groups_beyond_the_bound_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "GROUP", 8)
    firm = [f"Quelmiware {x} Systems" for x in ("Robotics", "Robotic", "Robotcs", "Rbotics", "Robotis", "Roobtics", "Robottics", "Robotiics", "Robotcis", "Robotisc")] * 3
    df = spark.createDataFrame([(n, False, n == firm[0]) for n in firm] + [("Quelmiware Marine Freight", False, True)], "name string, person boolean, official boolean")
    got = {r.name: r.entity for r in names.link_names(df).collect()}
    assert len({got[n] for n in firm}) == 1 and got["Quelmiware Marine Freight"] != got[firm[0]]


def test_large_groups_give_the_stars_of_one_pass(monkeypatch):
    rng = random.Random(4)
    words = ["robotics", "robotcs", "marine", "freight", "frieght", "copper", "coper", "mining", "m", "f", "systems", "sys", "paper", "ingrid", "inrgid", "maria", "mario"]
    for person in (True, False):
        for _ in range(40):
            keys = {" ".join(sorted([core, *rng.sample(words, rng.randint(0, 3))])): core for core in rng.choices(["quelmira", "quelmria"], k=60)}
            members = sorted((-rng.randint(1, 9), key, core) for key, core in keys.items())
            monkeypatch.setattr(names, "GROUP", 10**9)
            want = names._cluster(members, person)
            monkeypatch.setattr(names, "GROUP", 0)
            assert names._cluster(members, person) == want


def test_words_that_may_reach_the_bound_are_looked_up():
    rng = random.Random(2)
    hits = 0
    for _ in range(4000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 15)))
        b = a
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b))
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + "c" + b[i:], b[:i] + "d" + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :]]) or "a"
        index = names._Centres()
        index.add(7, [b])
        if names.token_similarity(a, b) >= names.MATCH - names.SAME_CORE:
            hits += 1
            assert index.like([a]) == [7], (a, b)
    assert hits > 1000


def test_links_do_not_depend_on_the_size_of_the_table(spark):
    rng = random.Random(6)
    last = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(14)]
    rows = [(n, True, False) for x in last for n in (f"Ingrid {x}", f"{x}, Ingrid", f"Inrgid {x}", f"INGRID {x}")]
    other = [("".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(7)), False, False) for _ in range(12_000)]

    def groups(table):
        out = {}
        for r in names.link_names(spark.createDataFrame(table, "name string, person boolean, official boolean")).collect():
            out.setdefault(r.entity, set()).add(r.name)
        return {frozenset(g & {x[0] for x in rows}) for g in out.values()} - {frozenset()}

    small = groups(rows)
    assert small == {frozenset((f"Ingrid {x}", f"{x}, Ingrid", f"Inrgid {x}", f"INGRID {x}")) for x in last}
    assert groups(rows + other) == small


def test_misspelt_tokens_meet_at_every_length(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    for n in (4, 5, 6, 7, 8, 9, 11, 12, 14, 20):
        for _ in range(12):
            w = "".join(rng.choice(letters) for _ in range(n))
            i = rng.randrange(n - 1)
            v = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            if n >= 6:
                j = rng.randrange(n)
                v = v[:j] + rng.choice(letters) + v[j + 1 :]
            pairs += [(w, v)] if v != w else []
            pairs += [(w, w[: n - 3])] if n in (12, 14) else [(w, w[:-1])] if n > 4 else []
    rows = {w: 3 for w, _ in pairs} | {v: 0 for _, v in pairs}
    got = {(r.a, r.b) for r in names._token_links(spark.createDataFrame(list(rows.items()), "token string, proof long")).collect()}
    tokens_ = sorted(rows)
    want = {(s, t) for s in tokens_ for t in tokens_ if s != t and rows[s] < 3 and (rows[t], t) > (rows[s], s) and names.osa(s, t, names.allowed(max(len(s), len(t)))) <= names.allowed(max(len(s), len(t)))}
    assert got == want and len(want) >= 150


# 5 and 7
def brute(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice(([], [rng.choice(WORDS)], [w[i], rng.choice(WORDS)]))
    return " ".join(w)


def shingled(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.8])
def test_similar_sets_find_what_brute_force_finds(spark, threshold):
    rng = random.Random(int(threshold * 10))
    base = [text(rng, rng.choice((12, 40, 150, 300))) for _ in range(25)]
    rows = [(i * 10 + j, edited(rng, b, j * max(1, len(b) // 700))) for i, b in enumerate(base) for j in range(5)]
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, ""), (903, "two words"), (904, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = N.cut(N.text_sets(df, "id", "t", 3))
    got = {tuple(r) for r in N.expand_pairs(sets, N.similar_classes(sets, threshold)).collect()}
    want = brute({i: shingled(t or "") for i, t in rows}, threshold)
    assert not got - want and len(want - got) <= 0.03 * len(want)


@pytest.mark.parametrize("size, similarity, threshold", [(63, 0.7, 0.7), (63, 0.75, 0.7), (56, 0.72, 0.7), (125, 0.71, 0.7), (250, 0.71, 0.7), (60, 0.6, 0.6), (125, 0.6, 0.6)])
def test_pairs_at_the_top_of_a_band_share_a_signature(size, similarity, threshold):
    rng = np.random.default_rng(6)
    common = int(np.ceil(2 * size * similarity / (1 + similarity)))
    found = 0
    for _ in range(300):
        u = rng.choice(1 << 32, 2 * size - common, replace=False).astype(np.uint32)
        s, d = N.signatures(np.concatenate([np.sort(u[:size]), np.sort(u[size - common :])]), np.array([size, size]), threshold)
        found += bool(set(s[d == 0]) & set(s[d == 1]))
    assert found >= 297


def test_hot_signatures_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    base = text(rng, 120)
    rows = [(i, base + " " + text(rng, 8)) for i in range(30)]
    monkeypatch.setattr(N, "HOT", 10)
    sets = N.cut(N.text_sets(spark.createDataFrame(rows, "id long, t string"), "id", "t", 3))
    got = {tuple(r) for r in N.expand_pairs(sets, N.similar_classes(sets, 0.7)).collect()}
    assert got == brute({i: shingled(t) for i, t in rows}, 0.7)


def test_a_shingle_in_a_third_of_the_sets_is_spread_and_loses_nothing(spark, monkeypatch):
    from quarry.llm import prefix_join as P

    rng = random.Random(8)
    rows = [(i, text(rng, 14) + " one two three four five six" if i % 3 == 0 else text(rng, 20)) for i in range(240)]
    rows += [(1000 + i, edited(rng, rows[i][1], 2)) for i in range(0, 240, 4)]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = N.cut(N.text_sets(df, "id", "t", 3))
    want = brute({i: shingled(t) for i, t in rows}, 0.6)
    table = P.order_table(P.shingle_counts(sets))
    monkeypatch.setattr(P, "SPLIT", 20)
    h = np.array([5, 5, 9], np.uint32)
    at, r = P._cells(h, np.array([1, 2, 3]), np.full(3, 28), 0.0, 50)  # 2**7 sets: seven shards
    assert len(at) == 3 * 7 and {frozenset(r[at == i]) for i in (0, 1)} and set(r[at == 0]) & set(r[at == 1])
    pairs = P.candidates(sets, 0.6, table=table)
    got = {tuple(x) for x in N.expand_pairs(sets, N.verified(sets, pairs, 0.6)).collect()}
    assert got == want and want


def test_signatures_hot_in_one_batch_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    base = text(rng, 120)
    rows = [(i, base + " " + text(rng, 8)) for i in range(30)] + [(100 + i, text(rng, 100)) for i in range(20)]
    monkeypatch.setattr(N, "LOCAL_HOT", 4)
    sets = N.cut(N.text_sets(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", 3))
    got = {tuple(r) for r in N.expand_pairs(sets, N.similar_classes(sets, 0.7)).collect()}
    assert got == brute({i: shingled(t) for i, t in rows}, 0.7)


def test_overlaps_across_splits(spark):
    rng = random.Random(4)
    t = text(rng, 60)
    rows = [(1, "train", t), (2, "test", t), (3, "validation", edited(rng, t, 3)), (4, "test", text(rng, 60)), (5, "train", "Hi"), (6, "test", " Hi "), (7, "train", None), (8, "test", t), (9, "train", t)]
    df = spark.createDataFrame(rows, "record_no long, split string, prompt string")
    assert {tuple(r) for r in O.overlaps(df).collect()} == {(1, 2), (1, 3), (1, 8), (2, 9), (3, 9), (5, 6), (8, 9)}
    assert O.overlaps(df.limit(0)).count() == 0
    assert {r.e: r.k for r in O.exact_counts(df).collect()} == {2: 2, 6: 1, 8: 2}


# 6
def test_main_content_from_markup_alone():
    rng = random.Random(5)
    firms = [f"Firm{i} Works" for i in range(30)]
    pages, plain = [], []
    for i in range(80):
        body = [f"{rng.choice(firms)} said that output of the plant rose by {rng.randint(2, 90)} percent after the repair, and buyers were told to wait." for _ in range(4)]
        junk = ["Subscribe | Log in | Careers", "Accept all cookies", f"You have {i} free articles left this month."]
        pages.append("\n".join(f"<li>{j}</li>" for j in junk[:2]) + "\n\n" + "\n\n".join(f"<p>{b}</p>" for b in body) + f"\n<span>{junk[2]}</span>")
        plain.append("\n".join(junk[:2]) + "\n\n" + "\n\n".join(body) + "\n" + junk[2])
    model = M.fit_pages(pages)
    lines = M.parse(pa.array([*plain[:20], None, ""], pa.large_string()), model.weights)
    kept = lines.no[np.flatnonzero(model.keep(lines))]
    assert sorted(set(kept.tolist())) == [4, 6, 8, 10] and len(kept) == 80


def test_main_content_table(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", None, None)], "id long, raw_text string, source_url string, provider string")
    assert M.main_body_lines(df, M.fit_from(df)).count() == 0


# 8
def test_packing_whole_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_PARTITION", 200)
    rng = random.Random(6)
    rows = [(i, rng.choice((5, 90, 300, 700, 1024, 2500, 0))) for i in range(1500)] + [(9999, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, size long")).collect()
    used: dict = {}
    for r in out:
        used[r.container] = used.get(r.container, 0) + r.size
    total = sum(s or 0 for _, s in rows)
    assert sum(used.values()) == total and max(used.values()) <= 1024
    assert {r.doc_id for r in out} == {i for i, _ in rows} and {r.doc_id for r in out if r.piece == 1} == {i for i, s in rows if s and s > 1024}
    assert len(used) <= total / 1024 * 1.06 + 2


def test_items_that_fit_with_none_end_without_one_large_task(spark):
    rows = [(i, 600) for i in range(3000)] + [(5000 + i, 400) for i in range(50)]
    out = packing.pack(spark.createDataFrame(rows, "key long, size long"), per_partition=300).collect()
    used: dict = {}
    for r in out:
        used.setdefault(r.container, []).append(r.key)
    assert len(out) == len(rows) and len(used) == 3000 and sum(len(v) == 2 for v in used.values()) == 50


def test_long_texts_count_like_short_ones():
    from quarry.llm import sizes

    if not os.path.exists(sizes.VOCABULARY):
        pytest.skip("needs the vocabulary file")
    t = "Stocks of ball-valves, 12 days; 株式会社 は 続く. " * 4000
    assert sizes.count(t, sizes.VOCABULARY) == len(sizes.encoder(sizes.VOCABULARY).encode_ordinary(t))


def test_best_fit_prefers_tightest():
    assert [sorted(k) for k, _ in packing.best_fit([(6, 1), (5, 2), (4, 3), (5, 4)], 10)] == [[1, 3], [2, 4]]


# 9
def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(7)
    rows = [(i, "abc"[i % 3 if i % 10 else 2], rng.randint(20, 60)) for i in range(3000)] + [(5000, "tiny", 30)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 1), ("c", 0.1, 1), ("tiny", 0.05, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(sizes, targets)
    s = {r.source: r for r in shares.collect()}
    total = sum(z for *_, z in rows)
    assert {k for k, r in s.items() if r.short} == {"tiny", "none"} and s["tiny"].used == 120
    assert all(abs(s[k].used - s[k].target_share * total) <= 60 for k in "abc")
    assert max(r.times for r in chosen.collect()) <= 4 and sum(r.size * r.times for r in chosen.where("source = 'a'").collect()) == s["a"].used


# 10
@pytest.mark.parametrize(
    "t, want",
    [
        ("Dr. A. Smith paid 2.5 percent. Is it over?! Not yet.", ["Dr. A. Smith paid 2.5 percent.", "Is it over?!", "Not yet."]),
        ("“We lost it. It is gone,” said X. “Stop.” That was it.", ["“We lost it. It is gone,” said X.", "“Stop.”", "That was it."]),
        ("Output fell (it was idle. It broke) and rose. (A whole one.) End", ["Output fell (it was idle. It broke) and rose.", "(A whole one.)", "End"]),
        ("担当者は「足りない。未定だ」と述べた。「急ぐ。」とA氏は話した。次。", ["担当者は「足りない。未定だ」と述べた。", "「急ぐ。」とA氏は話した。", "次。"]),
        ("ต้นทุนเพิ่มขึ้น 27.3 เปอร์เซ็นต์ ลูกค้าหันไป", ["ต้นทุนเพิ่มขึ้น 27.3 เปอร์เซ็นต์", "ลูกค้าหันไป"]),
        ("Overview\n- one item\n1. Two\nText here.Next one.", ["Overview", "- one item", "1. Two", "Text here.", "Next one."]),
        ("Im 3. Quartal sank z. B. der Umsatz. Das Werk ruht.", ["Im 3. Quartal sank z. B. der Umsatz.", "Das Werk ruht."]),
        ("  \n ", []), ("", []),
    ],
)
def test_sentences(t, want):
    got = S.sentence_spans(t)
    assert [t[a:b] for a, b in got] == want


def test_sentences_leave_only_white_space_out():
    rng = random.Random(8)
    alphabet = "aB. ?!\n“”()「」。3é…\"'"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        spans = S.sentence_spans(t)
        left = set(range(len(t))) - {i for a, b in spans for i in range(a, b)}
        assert all(t[i].isspace() for i in left) and all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_token_hashes_do_not_depend_on_place():
    h, o = tokens.token_hashes(tokens.lower_words(pa.array(["Ab cd", "", "x—cd é"], pa.large_string())), tokens.WORDS)
    assert o.tolist() == [0, 0, 2, 2, 2] and h[1] == h[3] and len(set(h.tolist())) == 4
