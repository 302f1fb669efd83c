from __future__ import annotations

import hashlib
import random
import time
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("evidora.llm.folding")

from evidora.llm import containers, encodings, folding, leaks, near_duplicates, scans, splitting, truncation, vector_graph  # noqa: E402

WORDS = "safra porto café ação índice renda crédito obra frete turismo câmbio estiagem preço energia emprego formal saldo região".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def words(text):
    return re.findall("[a-z0-9]+", folding.fold_text(text or ""))


def rows(df):
    return {tuple(r) for r in df.collect()}


@given(st.lists(st.text(alphabet="aé ÇºﬁX1½́-Ñ\n٣", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_folded_words_are_those_of_the_definition(texts):
    h, no = folding.folded_words(texts)
    expected = [w for t in texts for w in words(t)]
    assert len(h) == len(expected)
    if expected:
        assert (folding.word_hash(expected) == h).all()
        assert no.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]


def jaccard_pairs(docs, n, percent):
    sets = {i: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for i, t in docs if (w := words(t)) is not None}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    docs, base = [], [prose(rng, 80) for _ in range(25)]
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = "nova" + str(rng.randrange(99))
        docs.append((i, " ".join(w)))
    docs += [(500, docs[0][1]), (501, docs[0][1].upper()), (502, None), (503, ""), (504, "só duas"), (505, "x " * 20_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, cls string")
    got = rows(near_duplicates.near_duplicate_pairs(df, percent=60, words=3))
    want = jaccard_pairs([(i, t) for i, t in docs if i != 505], 3, 60)
    assert got == want
    groups = near_duplicates.near_duplicate_groups(df, percent=60, words=3).toPandas().set_index("doc_id")
    assert set(groups.index) == {i for i, t in docs if len(words(t)) >= 3}
    for a, b in want:
        assert groups.group_id[a] == groups.group_id[b]
    assert groups.class_id[500] == groups.class_id[501] == groups.class_id[0] and all(g <= i for i, g in groups.group_id.items())
    assert not rows(near_duplicates.near_duplicate_pairs(df.limit(0)))


def test_postings_of_a_class_meet_as_one_node_in_any_order():
    import pyarrow as pa

    def posting(keys, print_):
        n = len(keys)
        return np.concatenate([near_duplicates._planes(np.array(x, dtype=np.uint64), b) for x, b in ((keys, 5), ([0] * n, 2), ([print_] * n, 3))]).tobytes()

    postings = {0x1000: posting([5, 9], 7), 0x2000: posting([5, 9], 7), 0x3000: posting([5, 9], 8)}  # two copies of class 7
    for order in ((0x1000, 0x2000, 0x3000), (0x3000, 0x2000, 0x1000)):
        got = near_duplicates._merged(pa.table({"bucket": [0] * 3, "block": list(order), "postings": [postings[b] for b in order]}))
        assert set(zip(*(got.column(c).to_pylist() for c in ("a", "b")), strict=True)) == {(0x1000, 0x3000)}


def test_unrelated_texts_of_a_long_list_do_not_meet():
    import pyarrow as pa

    rng = random.Random(6)
    near, texts = near_duplicates, []
    for i in range(60):
        w = texts[-1].split() if i % 3 else "frase de praxe da casa".split() + [f"n{rng.randrange(10**6)}" for _ in range(rng.choice((40, 90, 300)))]
        for _ in range(rng.randrange(6) if i % 3 else 0):
            w[rng.randrange(len(w))] = f"m{rng.randrange(99)}"
        texts.append(" ".join([*w, f"z{i}"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc", "text"])
    (signed,) = near._signatures(3)([batch])
    sketches = pa.Table.from_batches(list(near._sketches([signed])))
    nodes, sets = sketches.column("node").to_pylist(), [set(s) for s in (zip(w, w[1:], w[2:]) for w in (x.split() for x in texts))]
    true = {(nodes[a], nodes[b]) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    key, flags = np.full(60, 5, np.uint64), np.arange(60, dtype=np.uint64)
    prints = np.arange(60, dtype=np.uint64)
    posting = b"".join(near._planes(v, n).tobytes() for v, n in ((key, 5), (flags, 2), (prints, 3)))
    table = pa.table({"bucket": [3], "block": [nodes[0]], "postings": [posting]})
    met = near._merged(table, 10)
    assert met.num_rows == 60 and set(met.column("a").to_pylist()) == {53} and max(met.column("asked").to_pylist()) < 0  # members, not 1,770 pairs
    members = pa.table({"list": met.column("a"), "node": met.column("b"), "asked": met.column("asked")}).join(sketches.drop(["cls", "bits"]), "node")
    bits = dict(zip(nodes, sketches.column("bits").to_pylist(), strict=True))
    members = members.append_column("bits", pa.array([bits[n] for n in members.column("node").to_pylist()], pa.binary()))
    got = near._met_in_long_lists(60)(members)
    found = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    assert true and true <= found and len(found) < 2 * len(true) and set(got.column("asked").to_pylist()) == {2}
    size = dict(zip(nodes, sketches.column("size").to_pylist(), strict=True))
    every = [(a, b) for a in nodes for b in nodes if a < b]
    kept = next(near._bounded(60)([pa.RecordBatch.from_pylist([{"cls_a": a, "cls_b": b, "size_a": size[a], "bits_a": bits[a], "size_b": size[b], "bits_b": bits[b]} for a, b in every])]))
    assert set(zip(kept.column("cls_a").to_pylist(), kept.column("cls_b").to_pylist(), strict=True)) == found


def test_near_duplicates_in_rounds_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ROUND", 6_000)
    monkeypatch.setattr(near_duplicates, "SHORT", 3)
    monkeypatch.setattr(near_duplicates, "MEMBERS", 200)
    test_near_duplicates_match_brute_force(spark)


def test_near_duplicates_keep_no_shuffles_and_no_signatures(spark):
    from pathlib import Path

    from evidora.scratch import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\w+\.data", manager.getAllFiles().mkString("\n")))
    rng = random.Random(4)
    df = spark.createDataFrame([(i, prose(rng, 40)) for i in range(60)] + [(99, None)], "doc_id long, text string")
    before, kept = shuffles(), set(shared.iterdir())
    near_duplicates.near_duplicate_pairs(df)
    for _ in range(50):  # files are removed in the background
        left = shuffles() - before
        if len(left) <= 4:  # of the counters, which are collected
            break
        time.sleep(0.2)
    assert len(left) <= 4 and not any(p.name.startswith("signatures") for p in set(shared.iterdir()) - kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 60)) for i in range(40)]
    items = []
    for k in range(12):
        w = docs[k][1].split()
        items.append((k, " ".join(w[5 : 5 + 7 + k]), None if k % 3 else prose(rng, 12)))
    docs += [(90, None), (91, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, first string")
    it = spark.createDataFrame(items, "item_id long, a string, b string")
    want = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for k, *fields in items:
            for f in fields:
                v = words(f)
                if any(tuple(v[i : i + 10]) in grams for i in range(len(v) - 9)):
                    want.add((d, k))
    assert rows(leaks.leaked_items(df, it, ["a", "b"], 10)) == want and want
    near = set()
    for d, t in docs:
        w = words(t)
        for k, *fields in items:
            for f in fields:
                v = words(f)
                for i in range(len(v) - 5):
                    for p in [p for p, x in enumerate(w) if x == v[i]]:
                        q = p
                        for x in v[i + 1 : i + 6]:
                            q = next((j for j in range(q + 1, len(w)) if w[j] == x), len(w) + 99)
                            if q > len(w):
                                break
                        if q - p + 1 <= 6 + 2:
                            near.add((d, k))
    gaps = [(d, re.sub(r"(\S+ \S+ \S+) ", r"\1 então ", t) if d % 2 and t else t, "x") for d, t in docs]
    spaced = spark.createDataFrame(gaps, df.schema)
    assert rows(leaks.leaked_items(df, it, ["a", "b"], 6, slack=2)) == near
    assert {k for k, _ in rows(leaks.leaked_items(spaced, it, ["a", "b"], 6, slack=2))} == {k for k, _ in near} and rows(leaks.leaked_items(spaced, it, ["a", "b"], 6)) < near
    assert not rows(leaks.leaked_items(df.limit(0), it, ["a", "b"], 10))
    assert not rows(leaks.leaked_items(df, it.limit(0), ["a", "b"], 10))


def test_nearest_vectors_reach_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    v = np.concatenate([c + rng.normal(size=(20, 64)) * 0.3 for c in centres]).astype(np.float32)
    v = np.concatenate([v, v[:7], np.repeat(v[:1], 9, axis=0), v[3:4] * 2])
    data = [(i, [float(x) for x in r], "z") for i, r in enumerate(v)]
    data += [(9000, None, "z"), (9001, [], "z"), (9002, [0.0] * 64, "z"), (9003, [float("nan")] * 64, "z"), (9004, [1.0] * 63, "z")]
    df = spark.createDataFrame(data, "vec_id long, vector array<float>, hi string")
    got = rows(vector_graph.neighbour_pairs(df, 5, 0.8))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(v)):
        c = np.flatnonzero(s[i] >= 0.8)
        for j in c[np.lexsort((c, -s[i, c]))][:5]:
            want.add((min(i, j), max(i, j)))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert not rows(vector_graph.neighbour_pairs(df.limit(0), 5, 0.8))
    assert not rows(vector_graph.neighbour_pairs(df.where("vec_id >= 9000"), 5, 0.8))


@given(st.lists(st.sampled_from(["palavra", "fim.", "\n\n", "\n", " ", "x" * 37, "1.2 Título", "ação;"]), max_size=60), st.integers(20, 60), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_the_limit(parts, limit, overlap):
    text = " ".join(parts)
    pieces = splitting.split_text(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s1, e1, _), (s2, e2, _) in zip(pieces, pieces[1:], strict=False):
        assert s1 < s2 <= e1 < e2 and e1 - s2 <= overlap
    longest = max((len(x) for x in text.split()), default=0)
    assert (longest > limit) == any(level == "character" for _, _, level in pieces)


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, "a " * 900, "p"), (2, None, "p"), (3, "", "p"), (4, "y" * 3000, "p")], "page_id long, text string, pieces string")
    assert splitting.split_text("w " * 90 + "b" * 1000 + " c", 1024, 200)[:2] == [(0, 180, "word"), (156, 1180, "word")]  # a word that fits is not cut
    assert rows(splitting.rebuilt(df, 1024, 200, "page_id")) == {(i, hashlib.md5(t.encode()).hexdigest(), True) for i, t in ((1, "a " * 900), (4, "y" * 3000))}
    assert rows(splitting.oversized(df, 1024, 200, "page_id")) == {(1, "natural"), (4, "forced")}
    assert {r.page_id: len(r.pieces) for r in splitting.with_pieces(df, 1024, 200).collect()} == {1: 2, 2: 0, 3: 0, 4: 4}


@pytest.mark.parametrize("true, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp850")])
def test_wrong_encodings_are_found_and_restored(spark, true, read):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(WORDS) for _ in range(40)) + ". O índice (½ ± 1) usa § e ©, às vezes." for _ in range(60)]
    broken = [c.replace("½ ± 1", "base").replace("§ e ©", "marcas").encode(true).decode(read, "ignore") for c in clean[:6]]
    data = [("t", str(i), "text", "s", t) for i, t in enumerate(clean + broken)] + [("t", "n", "text", None, None), ("t", "e", "text", "s", ""), ("t", "f", "text", "s", "informa��o")]
    df = spark.createDataFrame(data, "tbl string, rec string, field string, source string, text string")
    assert rows(encodings.garbled_fields(df)) == {("t", str(60 + i), "text", 1) for i in range(6)} | {("t", "f", "text", 0)}
    if true == "utf-8" and read != "cp1251":
        fixed = {r.rec_id: r.repaired for r in encodings.repaired_fields(df).collect()}
        assert fixed["60"] == clean[0].replace("½ ± 1", "base").replace("§ e ©", "marcas")
    assert not rows(encodings.garbled_fields(df.limit(0)))


def test_trie_finds_every_word_within_two_edits():
    rng = random.Random(5)
    lexicon = sorted({"".join(rng.choice("abcl1") for _ in range(rng.randrange(2, 7))) for _ in range(300)})

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
            last = row
        return last[-1]

    trie = scans.Trie(lexicon)
    for _ in range(60):
        w = "".join(rng.choice("abcl1") for _ in range(rng.randrange(1, 8)))
        assert sorted(trie.within(w)) == [x for x in lexicon if distance(w, x) <= 2]


def scanned_pages():
    body = "Na margem, o índice de confiança expandiu-se em 21,1% no período, diante da energia. O comércio cresceu 305,5 milhões no trimestre.\n"
    clean = [(100 + i, "limpo.pdf", i, body * 3, "pdf_text") for i in range(20)]
    noisy = [
        (1, "anais.pdf", 1, "ANUÁRIO DE TESTE\nNa margem, o índice de confi-\nança expandiu-\nse em 2l,1% no perí0do,\ndiante da ener-\n- 1 -", "ocr"),
        (2, "anais.pdf", 2, "ANUÁRI0 DE TESTE\ngia. O cornércio cresceu 3o5,5 milhões no trimestre.\n2015\n- 2 -", "ocr"),
        (3, "anais.pdf", 3, None, "ocr"),
    ]
    return clean + noisy


def test_scanned_pages(spark):
    df = spark.createDataFrame([(*r, "f") for r in scanned_pages()], "page_id long, source_file string, page int, text string, extraction string, file string")
    want = {(1, "header", "ANUÁRIO DE TESTE"), (2, "header", "ANUÁRI0 DE TESTE"), (1, "page_number", "- 1 -"), (2, "page_number", "- 2 -"), (1, "hyphen", "confiança"), (1, "hyphen", "expandiu-se"), (1, "hyphen", "energia"), (1, "glyph", "21,1%"), (1, "glyph", "período"), (2, "glyph", "comércio"), (2, "glyph", "305,5")}
    assert rows(scans.page_defects(df)) == want
    text = {(r.page, r.paragraph): r.text for r in scans.continuous_text(df).collect()}
    assert text[1, 1] == "Na margem, o índice de confiança expandiu-se em 21,1% no período, diante da energia. O comércio cresceu 305,5 milhões no trimestre.\n2015"
    assert set(text) == {(1, 1)}
    assert not rows(scans.page_defects(df.limit(0)))


def test_a_misreading_that_no_confusion_explains(spark):
    body = "A produção de etanol cresceu com a demanda externa no período.\n"
    clean = [(100 + i, "limpo.pdf", i, body * 3, "pdf_text") for i in range(20)]
    noisy = [(1, "anais.pdf", 1, "A produção de etanol cresceu com a demxnda externa no perí-\nodo.", "ocr"), (2, "anais.pdf", 2, "A produção de etanxl cresceu.", "ocr")]
    df = spark.createDataFrame(clean + noisy, "page_id long, source_file string, page int, text string, extraction string")
    assert rows(scans.page_defects(df)) == {(1, "glyph", "demanda"), (1, "hyphen", "período"), (2, "glyph", "etanol")}


def test_cut_texts(spark):
    whole = ["A safra cresceu. O porto também.\n\n– Leste: 101.202\n– Norte: 12,5%\n– Sul: 448.515", "O frete caiu.\n\nA | 1,1% | 22 mil postos\nB | 3,4% | 10 mil postos", "Subiu em 2019.\n\nFonte: Usina; elaboração própria", "Caiu muito.\n\nANEXO ESTATÍSTICO"]
    data = [(i, w.replace("safra", "safra" + str(i)), "s") for i, w in enumerate(whole * 5)]
    cut = ["A safra cresceu. O por", "A safra cresceu. O porto também…", "O frete caiu.\n\nA | 1,1% | 22 mil po", "A safra cresceu.\n\n– Norte: 12,5%\n– Sul: 448.5", "Subiu. Caiu, ", "Subiu em 2019.\n\nFonte: Usi"]
    data += [(100 + i, c, "s") for i, c in enumerate(cut)]
    data += [(200, None, "s"), (201, "", "s"), (202, "Em 2018, a renda do porto subiu 448.", "s"), (203, "Em 2018, a renda do porto subiu 448.515 e caiu.", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.cut_texts(df).collect()} == {100 + i for i in range(len(cut))} | {202}
    rate = truncation.cut_rates(df, df.source).collect()
    assert [(r.source, r.documents, r.cut) for r in rate] == [("s", len(data), len(cut) + 1)]
    assert not rows(truncation.cut_texts(df.limit(0)))


def test_copies_of_a_cut_text_are_all_found(spark):
    # the ending of the cut text looks whole; only the longer copy shows that it was cut
    docs = [(i, "A safra rendeu 1.448.") for i in (4, 7, 9)] + [(5, "A safra rendeu 1.448. ")] + [(1, "A safra rendeu 1.448.515 reais."), (2, "A safra caiu."), (3, "A safra caiu."), (6, None), (8, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string")
    found = {r.doc_id for r in truncation.cut_texts(df).collect()}
    assert found == {4, 5, 7, 9}
    assert [(r.documents, r.cut) for r in truncation.cut_rates(df, df.source).collect()] == [(9, 4)]


def test_copies_of_a_cut_line_do_not_vote_for_it(spark):
    source, capitals = "A obra parou.\n\nFonte: Secretaria da Faz", "O frete caiu.\n\nANEXO ESTATÍST"
    whole = [f"A renda {i} subiu.\n\n{x}" for i in range(4) for x in ("Fonte: Usina; elaboração própria", "QUADRO GERAL")]
    data = list(enumerate([source] * 5 + [capitals] * 5 + whole))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id for r in truncation.cut_texts(df).collect()} == set(range(10))


def test_prefixes_match_brute_force(spark):
    rng = random.Random(6)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    data = list(enumerate(sorted(texts)))
    df = spark.createDataFrame(data, "doc long, text string")
    long = ["".join(rng.choice("ab") for _ in range(900)) for _ in range(3)]
    data += [(1000 + i, t[:n]) for i, (t, n) in enumerate((t, n) for t in long for n in (255, 256, 257, 511, 512, 600, 899, 900))] + [(2000, long[0][:600]), (2001, ""), (2002, None)]
    df = spark.createDataFrame(data, "doc long, text string")
    every = [t for _, t in data if t]
    want = {i for i, t in data if t and any(x != t and x.startswith(t) for x in every)}
    assert {r.doc for r in truncation.prefixes_of_longer(df).collect()} == want and 2000 in want
    assert not rows(truncation.prefixes_of_longer(df.limit(0)))


def test_last_words_that_go_on_elsewhere(spark):
    docs = [(1, "A safra de soja cresceu muito. A renda caiu."), (2, "Subiu a safra de so"), (3, "Caiu a safra de soja"), (4, "x"), (5, None), (6, "O porto de")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc long, text string, key string")
    assert {r.doc for r in truncation.cut_words(df).collect()} == {2}


@given(st.lists(st.integers(0, 6), min_size=2, max_size=9), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_bucket_bounds_are_optimal(counts, buckets):
    from itertools import combinations

    c = np.array([0, *counts])
    used = [int(x) for x in np.flatnonzero(c)]
    cost = lambda bounds: sum(int(c[s]) * (min(b for b in bounds if b >= s) - s) for s in used)
    got = containers.best_bounds(c, buckets)
    if used:
        best = min(cost([*x, used[-1]]) for n in range(min(buckets, len(used))) for x in combinations(used[:-1], n))
        assert cost(got) == best and len(got) <= buckets


def test_containers(spark):
    rng = random.Random(7)
    data = [(i, prose(rng, rng.randrange(1, 120)), "c") for i in range(300)] + [(900, prose(rng, 3000), "c"), (901, None, "c"), (902, "", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, container string")
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    for combine in (False, True):
        out = containers.packed(df, 512, path, combine=combine).toPandas()
        filled = out[out.container.notna()].groupby("container").tokens.sum()
        assert filled.max() <= 512 and filled.sum() / len(filled) > (0.9 if combine else 0.6) * 512
    sizes = out.groupby("doc_id").tokens.sum()
    assert set(sizes.index) == {d[0] for d in data}
    assert all(sizes[i] == containers.count_tokens(t, path) for i, t, _ in data if t)
    assert all(len(g) == 1 for i, g in out.groupby("doc_id") if sizes[i] <= 512)
    assert containers.packed(df.limit(0), 512, path).count() == 0


def test_vectors_are_sent_once_to_cells_that_lie_together(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 16))
    c = vector_graph.unit_rows(np.repeat(middle, 8, axis=0) + rng.normal(size=(48, 16)) * 0.01)
    together = vector_graph.cells_together(c)
    assert np.bincount(together).max() <= vector_graph.TOGETHER and len(together) == 48
    assert vector_graph.cells_together(c[:1]).tolist() == [0] and vector_graph.cells_together(np.ones((20, 16))).max() >= 2
    hit = c @ c.T >= 1 - vector_graph.MARGIN
    assert sum(len(set(together[row])) for row in hit) < hit.sum() / 3
