"""Each operator against a plain version, and on awkward tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, html_extract, language_id, line_dedup, ngram_join, pattern_packing, quality_rules, substring_dedup, token_output, toxicity
from kinweave.llm.bpe import encoder
from kinweave.llm.components import components
from kinweave.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm import brute

WORDS = ["alpha", "Beta", "gamma", "Delta,", "é", "漢字", "to", "of", "the", "x1", "zeta's", "#tag"]


def corpus(seed=0, n=60):
    """Texts with exact and near copies, shared lines and passages, repeats, and every awkward text."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(k))
    passage, line = text(50), text(6)
    rows = []
    for i in range(n):
        kind, own = i % 6, text(rng.randint(5, 90))
        if kind == 1 and rows:
            own = rng.choice(rows)[1] or ""
        elif kind == 2 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            if len(words) > 3:
                words[rng.randrange(len(words))] = "changed"
            own = " ".join(words)
        elif kind == 3:
            own = f"{own}\n{line.upper() if i % 2 else line} \n{own}"
        elif kind == 4:
            own = f"{own} {passage} {text(3)}"
        rows.append((i, own))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n\n "), (n + 3, "same " * 200), (n + 4, "\n".join(["one repeated line here"] * 5)), (n + 5, text(20_000)), (n + 6, "short"), (n + 7, "short")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def rows_of(df, *names):
    return {r["doc_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_lines(spark, docs):
    got = rows_of(line_dedup.dedup_lines(frame(spark, docs)), "text", "n_lines", "n_dropped")
    assert got == brute.lines(docs)
    small = rows_of(line_dedup.dedup_lines(frame(spark, docs), filter_bits=17), "text", "n_lines", "n_dropped")
    assert small == got  # a filter far too small sends more suspects and changes nothing


@pytest.mark.parametrize(("block", "narrow"), [(30_000, False), (40, False), (40, True)])
def test_classes(spark, docs, block, narrow):
    got = rows_of(ngram_join.similar_components(frame(spark, docs), block_shingles=block, narrow=narrow), "n_shingles", "component_id")
    assert got == brute.classes(docs)


def test_classes_of_five_words(spark, docs):
    assert rows_of(ngram_join.similar_components(frame(spark, docs), k=5, percent=80), "n_shingles", "component_id") == brute.classes(docs, 5, 80)


def test_classes_of_rows_with_repeated_and_missing_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [(5, " ".join(base)), (5, "quite another text of this id"), (9, near), (9, near), (None, near), (None, "nobody else has this"), (3, "quite another text of this id"), (2, None), (None, "")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_components(frame(spark, rows)).collect())
    assert got == sorted([("5", 57, "5"), ("5", 3, "3"), ("9", 57, "5"), ("9", 57, "5"), ("None", 57, "5"), ("None", 1, "None"), ("3", 3, "3"), ("2", 0, "2"), ("None", 0, "None")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=12), st.sampled_from([50, 80, 85]))
def test_divide_skip_links_what_is_similar(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    want = list(range(len(sets)))
    for pairs, out in ((ngram_join.divide_skip(arrays, percent), root),):
        for a, b in pairs:
            x, y = top(a), top(b)
            out[max(x, y)] = min(x, y)
    found = [top(i) for i in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert found == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=10), st.integers(0, 41), st.sampled_from([50, 80, 85]))
def test_a_slice_rules_out_no_link(sets, edge, percent):
    arrays = [np.array(sorted(x for x in s if x < edge), np.uint64) for s in sets]
    root = list(range(len(sets)))
    for a, b in ngram_join.divide_skip(arrays, percent, whole=np.array([len(s) for s in sets])):
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert root[i] == root[j]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.data())
def test_similar_sets_share_a_signature(base, data):
    base = sorted(base)
    gone = data.draw(st.sets(st.sampled_from(base)))
    more = data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=6))
    other = sorted((set(base) - gone) | more)
    if not other or 100 * len(set(base) & set(other)) < 85 * len(set(base) | set(other)):
        return
    a, b = (ngram_join._signatures(np.array(x, np.uint64), 85) for x in (base, other))
    assert np.intersect1d(a, b).size


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_path_and_a_star(spark, one_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame(edges[:0], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1, one_task=0)


def test_passages(spark, docs):
    got = rows_of(substring_dedup.dedup_passages(frame(spark, docs)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.passages(docs)
    assert rows_of(substring_dedup.dedup_passages(frame(spark, docs), filter_bits=12), "n_words", "n_removed", "kept_sha256") == got


def test_paths_are_compacted(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([f"a{rng.random()}" for _ in range(i + 3)] + passage)) for i in range(4)]
    spans = substring_dedup.repeated_spans(frame(spark, rows)).collect()
    assert sorted((r["start"], r["words"]) for r in spans) == [(i + 3, 300) for i in range(4)]
    assert len({(r["path_k1"], r["path_k2"], r["path_start"]) for r in spans}) == 1


def test_passages_of_rows_with_repeated_and_missing_ids(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "a " + passage), (1, "quite short"), (None, passage + " b c"), (None, "d e"), (2, "f"), (3, "g " * 30 + passage), (3, "g " * 30 + passage)]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    for n in ("_k1", "_k2", "_spans", "start", "words", "a.b", "a`b"):
        wide = wide.withColumn(n, F.lit("extra"))
    got = sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"], r["a.b"], r["a`b"]) for r in substring_dedup.dedup_passages(wide).collect())
    assert got == sorted((a, b, c, d, "extra", "extra") for a, b, c, d in [("1", "a", 41, 40), ("1", "quite short", 2, 0), ("None", "b c", 42, 40), ("None", "d e", 2, 0), ("2", "f", 1, 0), ("3", "", 70, 70), ("3", "", 70, 70)])


def test_contamination(spark, docs):
    rng = random.Random(5)
    items = [(0, " ".join((docs[4][1] or "").split()[2:40])), (1, " ".join((docs[10][1] or "").split()[:20])), (2, "short"), (3, None), (4, ""), (5, " ".join(rng.choice(WORDS) for _ in range(30))), (6, "gamma7 to9 of"), (0, "Short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.contamination(frame(spark, docs), bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(docs, items)
    assert any(v[-1] for v in got.values())


@pytest.mark.parametrize("bits", [26, 6])
def test_every_row_is_judged_by_its_own_text(spark, monkeypatch, bits):
    """Repeated ids, null ids and equal rows, with filters of any size and with every join shuffled."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "small_side", lambda df, row_bytes: df)
    rows = [(1, "one two three x y z"), (1, "nothing at all here"), (None, "one two three"), (None, "clean text"), (2, "one two three one two three"), (2, "one two three one two three")]
    bench = spark.createDataFrame([(7, "one two three"), (None, "x y")], "item_id long, text string")
    names = ["_k1", "_k2", "r1", "start", "spans", "items", "n_hit", "a`b", "_K1_"]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        wide = wide.withColumn(n, F.lit("extra"))
    out = decontaminate.contamination(wide, bench, with_text=True)
    got = sorted((str(r["doc_id"]), r["text"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect())
    assert got == sorted([("1", rows[0][1], 5, 1, True), ("1", rows[1][1], 0, 0, False), ("None", rows[2][1], 3, 1, True), ("None", rows[3][1], 0, 0, False), ("2", rows[4][1], 6, 1, True), ("2", rows[4][1], 6, 1, True)])
    assert {r["a`b"] for r in out.collect()} == {"extra"} and {"_k1", "_K1_", "spans"} <= set(out.columns)


def test_packed_rows_give_back_every_id(spark, docs):
    rows = token_output.packed_rows(frame(spark, docs), vocabulary(), length=256, buffer=3000).toArrow()
    parts = {}
    for row in rows.to_pylist():
        assert row["cu_lengths"][-1] == row["n_ids"] <= 256 and row["position_resets"] == row["cu_lengths"][:-1]
        for doc_id, piece, start, ids in token_output.unpacked(row, 256):
            parts[doc_id, piece] = (start, ids)
    assert token_output.read_ids(rows, 256).shape == (rows.num_rows, 256)
    own = encoder(vocabulary()).tokenizer
    for doc_id, text in docs:
        want = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = [parts[doc_id, k] for k in range(sum(d == doc_id for d, _ in parts))]
        assert np.concatenate([i for _, i in pieces]).tolist() == want
        assert all(len(i) == 256 for _, i in pieces[1:]) and [s for s, _ in pieces] == np.cumsum([0, *[len(i) for _, i in pieces]])[:-1].tolist()


def test_packing_places_each_piece_once(spark, docs):
    rows = pattern_packing.pack(frame(spark, docs), vocabulary(), length=256).collect()
    own = encoder(vocabulary()).tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs:
        want = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(want)
        assert all(zlib.crc32(want[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 256) + 3


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=8))
def test_plans_hold_every_piece(counts):
    plain, bins = 0, []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [b for b in bins if b >= n]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - n)
            else:
                bins.append(40 - n)
    plain = len(bins)
    for planned in (token_output.best_fit_decreasing(counts, 40), pattern_packing.plan(counts, 40)):
        held = {}
        for pattern, many in planned.items():
            assert sum(pattern) <= 40 and many > 0
            for n in pattern:
                held[n] = held.get(n, 0) + many
        assert held == counts
    assert sum(token_output.best_fit_decreasing(counts, 40).values()) == plain


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(7)
    lengths = np.clip(rng.lognormal(6.3, 0.8, 8000).astype(int), 1, 2048)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    placed, left = pattern_packing.fitted(counts, 2048)
    several = sum(len(p) * n for p, n in placed.items() if len(p) > 1)
    assert several > 4000 and all(sum(p) <= 2048 for p in placed)
    held = dict(counts)
    for p, many in placed.items():
        for n in p:
            held[n] -= many
    assert {n: c for n, c in held.items() if c} == {int(n): int(left[n]) for n in np.flatnonzero(left)}
    planned = pattern_packing.plan(counts, 2048)
    assert sum(planned.values()) <= -(-int(lengths.sum()) // 2048) + 4
    assert sum(len(p) * min(n, placed.get(p, 0)) for p, n in planned.items() if len(p) > 1) > 4000


def test_active_set_solves_the_fit():
    rng = np.random.default_rng(2)
    rows, x = rng.integers(0, 3, (40, 6)), np.zeros(40)
    x[[3, 7, 20]] = (5, 2, 9)
    found = pattern_packing.non_negative_fit(rows, x @ rows, np.zeros(40), np.ones(6))
    assert (found >= 0).all() and (found > 0).sum() <= 6 and found @ rows == pytest.approx(x @ rows, abs=1e-3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Be", "é", "1", "٣", " ", "  ", "\n", "\t", " ", "\u0085", "'s", "'", "'ll", "<|endoftext|>", "<", "!", "—", "漢", "😀", "ß", "\r\n", "_", "²", "\x1c"]), max_size=14))
def test_ids_are_those_of_the_tokenizer(parts):
    own, text = encoder(vocabulary()), "".join(parts)
    assert [x.tolist() for x in own.encode(pa.array([text, None, text + " a"]))] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text + " a")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them all right now.</p></div><aside><p>Some words at the side that nobody wants to read today.</p></aside>
<article><h1>Big &amp; bold</h1><p>One <b>two</b>   three&nbsp;four.<br>five<p>Tiny.</p><footer>By someone</footer><section class="comments"><p>I liked it very much, thanks.</p></section></article>
<form><p>Your name and your email address please.</p></form><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Big & bold One two three four. five Tiny."
    for broken in (None, "", "   ", "<!-- open", "<script>x", "<p", "<", "<a href='x"):
        assert html_extract.main_text(broken) == ""
    long = "word " * 50_000
    assert html_extract.main_text(f"<article><p>{long}</p></article>") == long.strip()


@pytest.mark.parametrize("name", ["comment-body", "post-comments", "sidebar-content", "footer-text", "cookie-content", "ad-text", "nav-main", "main-menu", "widget-body", "relatedPosts", "CommentList", "ad"])
def test_declared_parts_are_no_main_text(name):
    story = "<h1>Title here</h1><p>" + "word " * 40 + "</p>"
    page = f"<html><body class='has-sidebar'><article>{story}<div class='{name}'><p>{'other ' * 50}</p></div><p>Ok then.</p></article></body></html>"
    assert html_extract.main_text(page) == "Title here " + "word " * 40 + "Ok then."
    assert html_extract.main_text(page.replace("article", "div")) == "Title here " + "word " * 40 + "Ok then."


LONG, LINKS = " ".join(f"w{i}" for i in range(60)), "".join(f"<li><a href=x>Menu {i}</a></li>" for i in range(6))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<ul>{LINKS}</ul><h1>Head</h1><p>Yes.</p><p>{LONG}</p><p>{LONG}</p><p>Ok then.</p>", f"Head Yes. {LONG} {LONG} Ok then."),
        (f"<div>{LINKS}</div><div class=no-sidebar><h2>Two words</h2><p>{LONG}</p></div><ul>{LINKS}</ul>", f"Two words {LONG}"),
        (f"<article><p>{LONG}</p><video-js>kept</video-js><button-group>this too</button-group><p>{LONG}</p></article>", f"{LONG} kept this too {LONG}"),
        (f"<article><p>{LONG}</p><button>Buy</button><svg><text>x</text></svg><svg/><p>{LONG}</p><select><option>a</select></article>", f"{LONG} {LONG}"),
        (f"<main><header><h1>Of the article</h1></header><p>{LONG}</p><footer>by</footer></main><header>Of the page</header>", f"Of the article {LONG}"),
        (f"<div data-class='ad'><article><p>{LONG}</p><p>a</p><p>b</p></article></div>", f"{LONG} a b"),
        (f"<STYLE>p</STYLE><scripted><p>{LONG}</p></scripted><script", LONG),
    ],
)
def test_labelled_pages(page, want):
    assert html_extract.main_text(page) == want


def test_text_features_decide_most_blocks(spark):
    """On the driver's pages: the article's blocks are chosen and no others, and the share that the article flag helps with."""
    x, y = html_extract.labelled()
    tree, article = html_extract.trained(), html_extract.FEATURES.index("article")
    assert (tree.predict(x) == y).all() and tree.feature[0] != article
    asked = total = 0
    for (html,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        texts, features, candidates = html_extract.blocks(html)
        assert (candidates & tree.predict(features) == (features[:, article] == 1)).all()
        asked += tree.asks(features[candidates], article).sum()
        total += candidates.sum()
    print(f"{1 - asked / total:.3f} of {total} candidate blocks are decided without the article flag")
    assert asked < total / 2


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 41, 41] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_statistics(spark, docs):
    got = rows_of(quality_rules.statistics(frame(spark, docs)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        wordy = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        hit = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(words) < 1000 else set()
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(wordy) - len(set(wordy)), len(hit))
        assert got[i] == want


def test_rules_find_the_low(spark):
    rng = np.random.default_rng(3)
    x = rng.random((900, len(quality_rules.FEATURES)))
    low = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 0] < 0.3))
    rules = quality_rules.decision_list(x, low)
    judged = np.zeros(900, dtype=bool)
    for rule in rules:
        judged |= quality_rules.covered(rule, x)
    assert (judged == low).mean() > 0.97 and all(t.startswith("low if") for t in quality_rules.describe(rules))
    assert quality_rules.decision_list(x, np.zeros(900, dtype=bool)) == [] and quality_rules.decision_list(x[:0], low[:0]) == []
    row = spark.range(1).selectExpr("40L n_words", "200L word_chars", "39L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "1L n_lines", "0L n_upper", "0L n_digits", "0L n_marks", "40L n_distinct")
    assert row.select(quality_rules.verdict([[(2, True, 0.5)]]).alias("k")).first()["k"] is False and row.select(quality_rules.verdict([]).alias("k")).first()["k"] is True


def test_verdict_is_that_of_the_list(spark):
    """Every row's verdict against the rules applied one by one to its statistics, and its base rule."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.statistics(docs.select("doc_id", "text"))
    rules = quality_rules.train(stats, labels)
    assert rules
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(docs.select("doc_id", "text"), labels).collect()}
    own = stats.toPandas()
    x = own.select_dtypes("number")
    ratio = lambda a, b: x[a] / np.maximum(x[b], 1) if b else x[a]
    features = np.stack([ratio(*pair) for pair in (("n_words", None), ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_marks", "n_words"), ("n_distinct", "n_words"), ("n_words", "n_lines"))], 1).astype(float)
    for i, doc_id in enumerate(own["doc_id"]):
        failed = own["n_words"][i] < 20 or 100 * own["n_repeat_words"][i] > 30 * own["n_words"][i]
        low = any(all(features[i, f] > t if above else features[i, f] <= t for f, above, t in rule) for rule in rules)
        assert got[doc_id] == (failed, not failed and not low)


SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = toxicity.held_out()
    got = quality_rules.judge(docs.select("doc_id", "text"), labels.filter(~fold)).join(labels.filter(fold), "doc_id").filter("NOT base_failed").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    hit = got[got["predicted"] == 1]
    assert (hit["toxic"] == 1).mean() > 0.95 and (got[got["toxic"] == 1]["predicted"] == 1).mean() > 0.85
    assert got["score"].between(0, 1).all()


def test_non_negative_risk_does_not_fit_the_unlabelled():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (200, 1)), np.concatenate([rng.normal(2, 1, (120, 1)), rng.normal(-2, 1, (480, 1))])
    x = np.concatenate([p, u]).astype(np.float32)
    w, b = toxicity.non_negative_pu(x, np.arange(800) < 200, 0.2)
    assert ((u @ w + b > 0).mean()) == pytest.approx(0.2, abs=0.05)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    got = language_id.predict(docs).filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99


def test_mixed_text_has_two_languages():
    from kinweave.llm._text import Words, slices

    like = np.full((2, 1 << language_id.BITS), -9.0, np.float32)
    for k, word in enumerate((b"aaaa", b"bbbb")):
        data = np.frombuffer(word, np.uint8)
        codes, _ = language_id._trigrams(Words(data, np.array([0, 4]), language_id.LETTERS))
        like[k, codes] = -1.0
    _, data, offsets = next(iter(slices(pa.array(["aaaa " * 30, "aaaa " * 30 + "bbbb " * 10, "bbbb"]))))
    shares = language_id.mixtures(Words(data, offsets, language_id.LETTERS), like)
    assert shares[0, 0] > 0.99 and shares[1] == pytest.approx([0.75, 0.25], abs=0.01) and shares[2].argmax() == 1


def test_no_letters_is_undetermined(spark):
    rows = [(1, "hello there", "en"), (2, None, None), (3, "12 !!", "en"), (4, "", "en"), (6, "hello you there", "en"), (7, "bonjour toi", None)]
    got = rows_of(language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "lang_pred", "score")
    assert [got[i][0] for i in (2, 3, 4)] == ["und"] * 3 and got[1][0] == "en" and got[7][0] == "en"


EXTRA = ["n_lines", "n_words", "score", "kept", "component_id", "_drop", "_spans", "contaminated", "sequence_id", "held_out"]
#: Names that the operators use inside, and names that need quoting.
EXTRA += ["quality", "toxic", "_id", "_k1", "_k2", "rep", "near", "positive", "codes", "first", "last", "key", "k1", "item", "base_failed", "n_chars", "a b", "a.b", "a`b", "_0", "1"]


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 0, 0), (3, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    return {
        "lines": lambda d: line_dedup.dedup_lines(d),
        "classes": lambda d: ngram_join.similar_components(d),
        "rows": lambda d: token_output.packed_rows(d, vocabulary()),
        "passages": lambda d: substring_dedup.dedup_passages(d),
        "packing": lambda d: pattern_packing.pack(d, vocabulary()),
        "contamination": lambda d: decontaminate.contamination(d, bench),
        "no benchmark": lambda d: decontaminate.contamination(d, none),
        "quality": lambda d: quality_rules.judge(d, labels),
        "toxicity": lambda d: toxicity.scores(d, labels),
        "language": lambda d: language_id.predict(d.withColumn("lang", F.lit("en"))),
        "pages": lambda d: html_extract.extract(d.withColumnRenamed("text", "html")),
    }


@pytest.mark.parametrize("name", ["lines", "classes", "rows", "passages", "packing", "contamination", "no benchmark", "quality", "toxicity", "language", "pages"])
def test_awkward_tables(spark, name):
    run = operators(spark)[name]
    empty = frame(spark, [])
    assert run(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, "\n\n")]
    wide = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA:
        wide = wide.withColumn(c, F.lit("extra"))
    got = run(wide)
    least = 1 if name == "rows" else len(rows)
    assert got.count() == least or name == "rows"
    assert len(set(got.columns)) == len(got.columns)
    if name not in ("classes", "rows", "packing"):
        assert {"a b", "a.b", "a`b", "_k1", "_id"} <= set(got.columns)
        assert all(r["a`b"] == r["_k1"] == "extra" for r in got.collect())
    only_null = spark.createDataFrame([(5, None), (6, None)], "doc_id long, text string")
    assert run(only_null).count() >= 1


VARIED = [(1, "one text " * 30), (1, "quite another text " * 25), (None, "third text " * 30), (None, "one text " * 30), (2, "one text " * 30), (2, "one text " * 30)]


@pytest.mark.parametrize("name", ["quality", "toxicity", "language"])
def test_rows_of_one_id_are_judged_by_their_own_text(spark, name):
    """Rows that repeat an id, or have none, get the answer that a table with an id for each row would give."""
    run, given = operators(spark)[name], ("doc_id", "text", "held_out")
    got = run(frame(spark, VARIED).withColumn("row", F.monotonically_increasing_id() * 0 + F.crc32(F.col("text").cast("binary")))).collect()
    assert len(got) == len(VARIED)
    by_text = {}
    for r in got:
        own = tuple(v for c, v in r.asDict().items() if c not in given)
        by_text.setdefault(r["row"], set()).add(own)
    assert len(by_text) == 3 and all(len(v) == 1 for v in by_text.values())


def test_lines_of_rows_with_repeated_and_missing_ids(spark):
    rows = [(2, "shared line of words\na"), (2, "shared line of words\nb"), (None, "shared line of words"), (5, "SHARED line of words \nc"), (None, "only without an id"), (None, "only without an id")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([("2", "shared line of words\na"), ("2", "shared line of words\nb"), ("None", "shared line of words"), ("5", "c"), ("None", "only without an id"), ("None", "only without an id")])


def test_two_words_with_equal_polynomials_stay_apart(spark):
    """Thue and Morse's sequence and its complement collide under every polynomial modulo a power of two."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    own = encoder(vocabulary())
    assert [x.tolist() for x in own.encode(pa.array([a, b, a]))] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b, a)]
    rows = [(i, f"{x} one two three") for i, x in enumerate((a, b, a))]
    assert [v[1] for v in rows_of(ngram_join.similar_components(frame(spark, rows)), "n_shingles", "component_id").values()].count(0) == 2
    spread = [(i, " ".join(x)) for i, x in enumerate((a, b))]
    assert rows_of(substring_dedup.dedup_passages(frame(spark, spread)), "n_words", "n_removed", "kept_sha256") == brute.passages(spread)


def test_pieces_that_share_a_hash_are_compared(monkeypatch):
    from kinweave.llm import bpe

    monkeypatch.setattr(bpe, "mix", lambda x: x & np.uint64(3))
    own = bpe.Encoder(vocabulary())
    texts = ["some words of a text", "and others, of 12 more", "some of these words"]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_operator_has_a_query():
    assert [n for k in range(1, 11) for n in QUERIES if n.startswith(f"op{k}_")] == list(sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)", n)[1])))
    assert set(ORACLES) <= set(QUERIES)
