import glob
import hashlib
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, graph, html_extract, kernel, lbl_model, line_dedup, ngram_join, quality_crf, sentencepiece_wfst, setjoin, suffix_dedup, token_output
from tessera.llm import common

from . import brute

SCHEMA = "doc_id long, text string, k1 long, token string, n int"


def frame(spark, rows):
    """Documents with further columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], SCHEMA)


def near(rng, w):
    w = list(w)
    w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["wö" + str(k) for k in range(300)]
    out, passage = [], " ".join(rng.choice(vocab) for _ in range(60))
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(3, 120))]
        t = " ".join(w)
        if i % 5 == 0:
            t = t + "\n" + passage
        if i % 3 == 0:
            t = t.replace(" ", "\n", 3)
        out.append((i, t))
        for k in range(rng.choice([0, 0, 1, 3])):
            out.append((100 + 10 * i + k, " ".join(near(rng, w)) if k else t))
    base = [rng.choice(vocab) for _ in range(80)]
    out += [(1000 + k, " ".join(near(rng, near(rng, base)))) for k in range(60)]  # a large group of near copies
    out += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "One  Two"), (2005, "x" * 30_000), (2006, "x" * 30_000), (2007, "ab " * 5000), (2008, "é" * 99)]
    rng.shuffle(out)
    return out


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_exact_dedup(spark, rows):
    more = rows + [(5, dict(rows)[5]), (None, "one two"), (None, "one two"), (None, "alone"), (None, "alone")]
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(brute.exact(more), key=str)
    assert as_rows(exact_dedup.groups(frame(spark, more)), *cols) == want
    # a digest of one hex digit lets most texts collide: the bytes tell them apart
    assert as_rows(exact_dedup.groups(frame(spark, more), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)), *cols) == want
    left = exact_dedup.dedup(frame(spark, more))
    assert left.columns == ["doc_id", "text", "k1", "token", "n"] and left.count() == sum(r[3] for r in want)
    assert exact_dedup.groups(frame(spark, more).limit(0)).count() == 0


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, rows, n, num):
    more = rows + [(3, dict(rows)[3]), (None, "one two"), (None, None)]
    assert as_rows(ngram_join.classes(frame(spark, more), n, num, 100), "doc_id", "n_shingles", "component_id") == sorted(brute.classes(more, n, num, 100), key=str)


def test_later_orders_carry_only_units_in_pairs(spark, monkeypatch):
    docs = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(60)]
    docs.append((60, docs[7][1] + " more"))
    sent, whole = [], setjoin.prefixes

    def counted(*args):
        sent.extend(np.frombuffer(r["rows"], setjoin._ROW) for r in whole(*args).collect())
        return whole(*args)

    monkeypatch.setattr(setjoin, "prefixes", counted)
    got = as_rows(ngram_join.classes(frame(spark, docs), 4, 85, 100), "doc_id", "component_id")
    assert dict(got) == {k: k for k in range(60)} | {60: 7}
    rows = np.concatenate(sent)
    assert [len(np.unique(rows["unit"][(rows["pos"] & 7) == o])) for o in (0, 1)] == [61, 2]


def test_shuffle_files_go_with_their_table(spark, rows, monkeypatch):
    """The files that a scratch table is dealt by are removed as it stands, and the session's setting is as before."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p for d in files.localDirsString() for p in glob.glob(f"{d}/*/shuffle_*.data")}
    whole, left, setting = common.table, {}, spark.conf.get(common.REMOVES, None)

    def watched(df, name):
        had, until = shuffles(), time.time() + 5
        out = whole(df, name)
        while (new := shuffles() - had) and time.time() < until:
            time.sleep(0.05)
        left[name] = len(new)
        return out

    monkeypatch.setattr(common, "table", watched)
    got = ngram_join.classes(frame(spark, rows), 4, 85, 100)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.classes(rows, 4, 85, 100), key=str)
    assert {"places", "found", "members", "links"} <= set(left) and not any(left.values())
    assert spark.conf.get(common.REMOVES, None) == setting


def test_ngram_join_of_nothing(spark, rows):
    assert ngram_join.classes(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("planted", ["", "these words stand in every one of the documents there are and they come first"])
def test_frequent_tokens(spark, rows, planted):
    """Small blocks, most tokens frequent or hot, and a passage in every document: nothing is lost on any path."""
    more = [(i, f"{planted} {t}" if t and planted else t) for i, t in rows]
    for split in ({"often": 2, "large": 3, "tile": 20}, {"often": 10_000, "large": 2, "tile": 30}):
        got = ngram_join.classes(frame(spark, more), 4, 85, 100, **split)
        assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.classes(more, 4, 85, 100), key=str)
    got = line_dedup.line_dedup(frame(spark, more), often=2, large=3, tile=20)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.lines(more)


def test_tiles_hold_units_of_one_token(spark):
    """Units meet in a tile only under a token that both have, every two of a token do, and no unit is copied for what others share."""
    rows = [(100 * t + k if k else 100 * (t + 1) + 1, t, 30, 0) for t in range(12) for k in range(25)] + [(5000 + k, 99, 30, 0) for k in range(70)] + [(9999, 77, 30, 0)]
    tiles = setjoin._tiles(spark.createDataFrame(rows, "u long, token long, n long, before long"), setjoin.Spec(4, 85, 100, tile=30)).collect()
    met = set()
    for tile in {r["tile"] for r in tiles}:
        mine, other = ([r["u"] for r in tiles if r["tile"] == tile and r["mine"] == m] for m in (1, 0))
        met |= {(min(a, b), max(a, b)) for a in mine for b in other or mine if a != b}
    want = {(min(a, b), max(a, b)) for a, s, *_ in rows for b, t, *_ in rows if s == t and a != b}
    assert met == want and len(tiles) == 12 * 25 + 70 * 3


@pytest.mark.parametrize("by_rank", [False, True])
def test_pairs_that_share_the_token_before_are_left_to_it(by_rank):
    """Of equal sketches, only pairs with another token before are named; sizes too far apart never are."""
    n, before = [20, 20, 20, 40], [7, 7, 0, 0]
    cols = {"mine": [1] * 4, "u": [1, 2, 3, 4], "n": n, "before": before, "d": [1, 2, 3, 4], "line": [0] * 4, "state": [0] * 4, "sketch": [bytes(128)] * 4}
    spec = setjoin.Spec(4, 85, 100)
    got = [b for b in setjoin._tile_pairs(pa.table(cols), spec, by_rank, False)]
    pairs = {(a, b) for x in got for k, a, b in zip(*(x.column(c).to_pylist() for c in range(3))) if k == 0}
    assert pairs == ({(1, 3)} if by_rank else {(1, 3), (2, 3)})
    assert not list(setjoin._tile_pairs(pa.table(cols | {"before": [7] * 4}), spec, by_rank, False))


@pytest.mark.parametrize("by_rank", [False, True])
def test_open_pairs_leave_tiles_as_a_forest(by_rank):
    """Pairs that the first forest leaves open are compared in their tile: what leaves it follows the units, not their pairs."""
    rng, m = random.Random(7), 200
    sets = [sorted({k if rng.random() < 0.96 else 1000 * u + k for k in range(60)}) for u in range(1, m + 1)]
    cols = {"mine": [1] * m, "u": range(1, m + 1), "n": [60] * m, "before": [0] * m, "d": range(1, m + 1), "line": [0] * m}
    cols |= {"state": [0] * m if by_rank else range(1, m + 1), "sketch": [bytes(128)] * m}
    spec = setjoin.Spec(1, 85, 100)
    left = list(setjoin._tile_pairs(pa.table(cols), spec, by_rank, True))
    assert sum(b.num_rows for b in left) <= m
    part = pa.Table.from_batches(left).append_column("tokens", pa.array(sets))
    links = [(a, b) for x in setjoin._tile_links(part, spec, by_rank) for a, b in zip(*(c.to_pylist() for c in x.columns))]
    near = lambda a, b: 185 * len(set(sets[a - 1]) & set(sets[b - 1])) >= 85 * 120
    assert all(near(a, b) for a, b in links) and len(links) < m
    if by_rank:
        assert all(b < a for a, b in links) and {a for a, _ in links} == {a for a in range(1, m + 1) if any(near(a, b) for b in range(1, a))}
    else:
        every = [(a, b) for a in range(1, m + 1) for b in range(1, a) if near(a, b)]
        parts = [tuple(x.tolist() for x in graph._least(*np.array(e).T)) for e in (links, every)]
        assert parts[0] == parts[1] and len(every) > m


def test_tiles_are_parted_by_the_bytes_of_their_sets(spark, monkeypatch):
    rng, w = random.Random(7), [f"w{k}" for k in range(120)]
    more = [(k, " ".join("x" + str(k) if j in gone else v for j, v in enumerate(w))) for k in range(60) for gone in [rng.sample(range(120), rng.choice([1, 6, 12, 16]))]]
    monkeypatch.setattr(setjoin, "SETS", 20_000)
    for tile in (4000, 20):
        got = ngram_join.classes(frame(spark, more), 1, 85, 100, large=2, tile=tile)
        assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.classes(more, 1, 85, 100), key=str)


def test_links_over_texts_without_ids(spark):
    """A text that only rows without an id have joins two others."""
    w = [f"w{k}" for k in range(60)]
    other = lambda *at: " ".join("x" + v if k in at else v for k, v in enumerate(w))
    more = [(5, other(0)), (None, " ".join(w)), (2, other(59)), (None, "alone")]
    got = ngram_join.classes(frame(spark, more), 1, 95, 100)
    assert as_rows(got, "doc_id", "component_id") == sorted(((i, c) for i, _, c in brute.classes(more, 1, 95, 100)), key=str) == [(2, 2), (5, 2), (None, 2), (None, None)]


def test_leaks_over_rows_of_one_document(spark):
    w = [f"word{k}" for k in range(24)]
    docs = [(1, " ".join(w[:15])), (1, " ".join(w[10:])), (2, " ".join(w[:15])), (None, " ".join(w[:15])), (None, " ".join(w[10:]))]
    got = decontaminate.leaks(frame(spark, docs), spark.createDataFrame([(9, " ".join(w))], "item_id long, text string"))
    assert as_rows(got, "doc_id", "item_id", "n_item", "n_shared") == sorted(brute.leaks(docs, [(9, " ".join(w))]), key=str) == [(1, 9, 20, 20), (None, 9, 20, 20)]


def test_line_dedup(spark, rows):
    got = line_dedup.line_dedup(frame(spark, rows))
    want = brute.lines(rows)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert {r["doc_id"]: r["kept_sha256"] for r in got.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    odd = line_dedup.line_dedup(frame(spark, [(None, "a b c"), (1, "a b c"), (2, "A  b c\nd"), (3, None)]))
    assert sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=str) == [(1, ""), (2, "d"), (3, ""), (None, "a b c")]
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_splits_a_text_once(spark):
    rows = [(1, "a\nb\nc\n", [1]), (2, "x\n", None), (3, "", None), (4, "a", [0]), (5, "\n\nä", [0, 2])]
    got = line_dedup._strip(spark.createDataFrame(rows, "doc_id long, text string, gone array<int>"))
    assert as_rows(got, "doc_id", "text", "n_lines", "n_removed") == [(1, "a\nc\n", 4, 1), (2, "x\n", 2, 0), (3, "", 1, 0), (4, "", 1, 1), (5, "", 3, 2)]
    # none within a lambda, where it would run for each line
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("width", [100, 40])
def test_suffix_dedup(spark, rows, width, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), width)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == brute.repeats(rows, width)


def test_suffix_dedup_odd_rows(spark, rows):
    text = " ".join(str(k) for k in range(60))
    got = suffix_dedup.suffix_dedup(frame(spark, [(None, text), (4, "xx" + text), (4, "xx" + text)]))
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got.collect()), key=str) == sorted([(None, 0), (4, len(text)), (4, len(text))], key=str)
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_decontaminate(spark, rows):
    items = [(k, " ".join(t.split()[:20])) for k, (i, t) in enumerate(rows) if t and k % 9 == 0] + [(500, None), (501, "a b"), (502, dict(rows)[3]), (502, dict(rows)[6])]
    df = spark.createDataFrame(items, "item_id long, text string")
    more = rows + [(3, "another text under an id that is there already"), (None, dict(rows)[9])]
    got = sorted((tuple(r) for r in decontaminate.leaks(frame(spark, more), df).collect()), key=str)
    assert got == sorted(brute.leaks(more, items), key=str)
    left = decontaminate.decontaminate(frame(spark, more), df)
    bad = {i for i, *_ in got}
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, _ in more if i not in bad), key=str)
    assert decontaminate.leaks(frame(spark, rows), df.limit(0)).count() == 0 and decontaminate.leaks(frame(spark, rows).limit(0), df).count() == 0


def test_token_output(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = common.new_path(spark, "tokens")
    token_output.write(frame(spark, rows), path, out)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_output.digests(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    plan = token_output.read(spark, out).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    odd = common.new_path(spark, "tokens")
    token_output.write(frame(spark, [(None, "a"), (1, "b"), (1, "b"), (1, None)]), path, odd)
    assert sorted(r["start"] for r in token_output.digests(spark, odd).collect()) == [0, 2, 3, 5]
    none = common.new_path(spark, "tokens")
    token_output.write(frame(spark, rows).limit(0), path, none)
    assert token_output.digests(spark, none).count() == 0


def test_sentencepiece(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    odd = ["".join(rng.choice("ab et▁ \n.é日😀0\x00") for _ in range(50)) for _ in range(60)] + [" ", "  a", "a  ", "▁"]
    more = rows + [(9000 + k, t) for k, t in enumerate(odd)]
    for r in sentencepiece_wfst.encode_decode(frame(spark, more), path).collect():
        t = dict(more)[r["doc_id"]] or ""
        assert r["ids"] == sp.encode(t) and r["decoded"] == sp.decode(r["ids"])
        assert r["n_tokens"] == len(r["ids"]) and (r["decoded"] == t or "▁" in t)
    assert sentencepiece_wfst.encode_decode(frame(spark, rows).limit(0), path).count() == 0


def test_lm_scores(spark, rows):
    got = {r["doc_id"]: r for r in lbl_model.lm_scores(frame(spark, rows)).collect()}
    want, n = brute.unigram(rows)
    for i, (tokens, known, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, brute.held_out(i, 7))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    # how the rows lie makes no difference but for the order of sums
    other = {r["doc_id"]: r["score"] for r in lbl_model.lm_scores(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert all(other[i] == pytest.approx(r["score"], rel=1e-4) for i, r in got.items())
    assert lbl_model.lm_scores(frame(spark, rows).limit(0)).count() == 0
    assert lbl_model.lm_scores(frame(spark, [(None, "a"), (1, None)])).count() == 2


def test_lm_known_tokens_by_join(spark, rows, monkeypatch):
    monkeypatch.setattr(lbl_model, "KNOWN", 20)
    want, _ = brute.unigram(rows)
    for r in lbl_model.lm_scores(frame(spark, rows)).collect():
        assert (r["n_known"], pytest.approx(r["base_score"], rel=1e-9)) == want[r["doc_id"]][1:]


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    v = lbl_model.Vocabulary(np.sort(rng.integers(1, 1 << 60, 30).astype(np.uint64)), rng.integers(1, 50, 30), np.arange(1, 31), 31, 900, 40, 10, 10)
    par = lbl_model._start(31)
    m = lbl_model.scorer(par, v)
    p = np.exp(m.s1[:, None, :] + m.s2[None, :, :] - m.z[:, :, None]).sum(2)
    assert np.allclose(p, 1, atol=1e-3)


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "quiet", "river", "bends", "slowly", "north"]) for _ in range(12)) + "." for _ in range(5))
    junk = lambda: "\n".join(" ".join(rng.choice(["BUY###", "NOW$$$", "win|", "###"]) for _ in range(12)) for _ in range(5))
    rows = [(i, good() if i % 3 else junk()) for i in range(300)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    held = [i for i, _ in rows if brute.held_out(i, 4)]
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in held]) > 0.95
    odd = quality_crf.score(frame(spark, [(1, None), (1, ""), (None, "x\n\n")]), model).collect()
    assert len(odd) == 3 and all(0 <= r["score"] <= 1 for r in odd)
    none = quality_crf.train(docs, labels.limit(0))
    assert {round(r["score"], 9) for r in quality_crf.score(docs, none).collect()} == {0.5}
    assert quality_crf.keep_good(docs, model).columns == docs.columns and quality_crf.score(docs.limit(0), model).count() == 0


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    per, a = np.array([1, 3, 2]), rng.normal(size=(2, 2))
    e = rng.normal(size=6)
    got, at = quality_crf.marginals(e, per, a), 0
    for n in per:
        z, m = 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [(k >> t) & 1 for t in range(n)]
            p = np.exp(sum(e[at + t] * y[t] for t in range(n)) + sum(a[y[t], y[t + 1]] for t in range(n - 1)))
            z, m = z + p, m + p * np.array(y)
        assert np.allclose(got[at : at + n], m / z)
        at += n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First  para <i>with</i> marks.<br><p>Short.</p><div class="notice">Cookies!</div><p>Second&nbsp;para &lt;here&gt;.</p>
<form><input value="x">Sign up</form><section id="comments"><p>A reader's comment that is long enough to look like text.</p></section></article><aside>Side bar text</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "Head & line\nFirst para with marks.\nShort.\nSecond para <here>."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    plain = "<body><div><a>x</a><a>y</a></div><div><p>" + "A long paragraph of plain text. " * 5 + "</p><p>End.</p></div></body>"
    assert html_extract.extract(plain).endswith("\nEnd.")
    for broken in ("<![x", "<p", "<a href='", "&#xZ;&", "<p>a<![CDATA[b]]>c</p>"):
        assert isinstance(html_extract.extract(broken), str)
    df = spark.createDataFrame([(1, "u", PAGE, 3), (None, None, None, 3), (1, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    got = html_extract.pages_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect()) == sorted([0] + [len(html_extract.extract(PAGE))] * 2)
    assert html_extract.pages_text(df.limit(0)).count() == 0


def test_html_regions_by_their_ratios():
    """Elements whose names say nothing: the ratios tell link lists and short notes from the text, and without them all would stay."""
    words = "plain words of a long paragraph that goes on for a while and says a little more each time "
    links = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(9))
    text = [(words * k).strip() for k in (3, 5, 2)] + ["A short end."]
    for tag in ("div", "section"):
        page = f"<body><{tag} class='q1'><ul>{links}</ul></{tag}><{tag} class='q2'>Buy now.</{tag}><{tag} class='q3'>" + "".join(f"<p>{t}</p>" for t in text) + f"</{tag}><{tag} class='q4'><a href='/x'>x</a> | <a href='/y'>y</a></{tag}></body>"
        assert html_extract.extract(page) == "\n".join(text)
        parser = html_extract.Lines()
        parser.feed(page)
        parser.close()
        assert len(parser.lines) == 9 + 1 + len(text) + 1
        assert html_extract.content_regions(parser.lines, share=0.0) == {r for *_, r, _ in parser.lines}


def test_components(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (9, 9), (7, 8), (None, 1), (3, 5)], "u long, v long")
    for one_task in (0, 1000):
        assert sorted(map(tuple, graph.connected_components(e, one_task).collect())) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
        assert graph.connected_components(e.limit(0), one_task).count() == 0


def test_lines_and_words():
    data = np.frombuffer("a b\n\nc".encode() + b"" + "x\n".encode(), np.uint8)
    at, doc, per = kernel.lines(data, np.array([0, 6, 6, 8]))
    assert per.tolist() == [3, 1, 2] and doc.tolist() == [0, 0, 0, 1, 2, 2]
    assert kernel.words(data, np.array([0, 6, 6, 8]))[3].tolist() == [3, 0, 1]


def test_workers_give_memory_back(spark):
    """What a task has freed doesn't stay with its worker; every Python step of the pipeline's operators is wrapped so."""

    def run(batches):
        for b in batches:
            held = [bytes(1000) for _ in range(200_000)]
            kept = held[::50]
            del held
            yield b
            del kept

    def size(batches):
        for b in batches:
            with open("/proc/self/statm") as f:
                yield pa.RecordBatch.from_arrays([pa.array([int(f.read().split()[1]) * 4096])], ["id"])

    one = spark.range(1).coalesce(1)
    assert [r["id"] for r in one.mapInArrow(common.released(run), "id long").collect()] == [0]
    for module in (graph, quality_crf, sentencepiece_wfst, setjoin):
        with open(module.__file__) as f:
            calls = [line for line in f if ".mapInArrow(" in line]
        assert calls and all("common.released(" in line for line in calls)
    assert one.mapInArrow(size, "id long").first()["id"] < 1 << 30


def test_repeats_leave_no_tables_beside_the_texts(spark):
    """Only the runs lie in the shared folder when the texts are shuffled, and the filter of anchors grows with their number."""
    same = " ".join(f"word{k}" for k in range(60))
    before = len(common.CREATED)
    out = suffix_dedup.suffix_dedup(frame(spark, [(1, same), (2, "x" + same), (3, "alone")]))
    left = [p for p in common.CREATED[before:] if os.path.exists(p.removeprefix("file://"))]
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in left] == ["runs"]
    assert dict(as_rows(out, "doc_id", "n_removed")) == {1: 0, 2: len(same), 3: 0}
    assert [suffix_dedup._bitmap(spark.range(n).select("id"), "id")[1] for n in (10, 1 << 18)] == [20, 23]
