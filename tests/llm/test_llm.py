"""The training-data operators against plain versions on small tables, and on odd input."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import common, exact_dedup, html_text, jaccard_join, license_scan, lm_score, mixing, packing, quality, recurrent, shingles, substring_dedup, token_store, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
WORDS = ["w%d" % i for i in range(400)]


def _text(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def _docs(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    # columns whose names the operators use inside
    return df.withColumns({"n": F.lit(1), "size": F.lit(2), "kept": F.lit("x"), "token": F.lit(3)}) if extra else df


ODD = [None, "", " \n\t ", "one", "a b c d", "Zwei Wörter", "é́ ✓ 日本 語", "x" * 5000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def texts():
    base = _text(150)
    near = [" ".join("zz%d" % k if i == 7 * k else w for i, w in enumerate(base.split())) for k in range(1, 6)]
    passage = _text(60)
    spread = [f"{_text(30)} {passage} {_text(20)}" for _ in range(12)]
    return [*ODD, base, base, *near, *spread, *(_text(int(n)) for n in RNG.integers(1, 200, 40)), " ".join(WORDS * 20), *[base] * 30]


def _sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_exact_groups(spark, texts):
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(_docs(spark, texts)).collect()}
    norm = [t or "" for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(same), len(same), i == max(same))
    kept = exact_dedup.drop_exact_copies(_docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({max(j for j, u in enumerate(norm) if u == t) for t in norm})
    twice = _docs(spark, ["a", "a"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert exact_dedup.exact_groups(twice).filter("kept").count() == 1 and exact_dedup.drop_exact_copies(twice).count() == 1


def test_exact_groups_where_texts_share_a_digest(spark, texts):
    # the length is a digest that many texts share: they are told apart by their full texts
    docs = _docs(spark, texts)
    plain, weak = (sorted(map(str, exact_dedup.exact_groups(docs, **kw).collect())) for kw in ({}, {"digest": F.length}))
    assert weak == plain
    plain, weak = (sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, **kw).collect()) for kw in ({}, {"digest": F.length}))
    assert weak == plain
    # two texts of one id and one digest, each twice: one row of each stays
    rows = _docs(spark, ["ab", "cd", "ab", "cd"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r.text for r in exact_dedup.drop_exact_copies(rows, digest=F.length).collect()) == ["ab", "cd"]


INNER = ["__id", "__sha", "__s", "__k", "__hash", "__nth", "__n", "__h", "__spans", "__text", "__parts", "c0", "digest", "same", "k", "part", "hash", "nth", "passes", "parts", "mixed", "spans", "of_id", "text_sha256"]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(exact_dedup.sha256(text), 1, 1)])
def test_exact_groups_copy_only_large_ones(spark, monkeypatch, digest):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "ROWS_A_GROUP", 50)
    texts = [f"text {i % 100}" for i in range(200)] + ["of many"] * 300 + ["", None, "alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact_dedup._rows(docs, "doc_id", "text", exact_dedup.sha256)
    dealt, groups = exact_dedup._dealt(rows, exact_dedup._winners(rows, 4))
    assert groups.count() == 101 + 6 and dealt.select("part").distinct().count() == 6
    last, sizes = {t or "": i for i, t in enumerate(texts)}, Counter(t or "" for t in texts)
    found = exact_dedup.exact_groups(docs, digest=digest).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(i, last[t or ""], sizes[t or ""], i == last[t or ""]) for i, t in enumerate(texts)}
    assert len(found) == len(texts)
    kept = exact_dedup.drop_exact_copies(docs, digest=digest)
    assert {r.doc_id for r in kept.collect()} == set(last.values()) and kept.count() == len(last)


@pytest.mark.parametrize("run", [exact_dedup.drop_exact_copies, mixing.mix_documents, substring_dedup.cut_repeats, jaccard_join.drop_near_copies, quality.keep_quality])
def test_columns_named_like_inner_ones(spark, run):
    passage = _text(60)
    docs = _docs(spark, [None, "", *[f"{_text(30)} {passage}" for _ in range(3)], *[_text(70)] * 2], extra=False)
    marked = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in INNER})
    rows, plain = run(marked).collect(), run(docs).collect()
    assert sorted(str(r[:5]) for r in rows) == sorted(str(r[:5]) for r in plain)
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in INNER)
    assert run(marked).columns == marked.columns


def test_jaccard_components(spark, texts):
    sets = _sets(texts)
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    docs = _docs(spark, texts)
    rows = jaccard_join.near_duplicate_classes(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(i, len(s), comp[i]) for i, s in enumerate(sets)]
    assert jaccard_join.drop_near_copies(docs).columns == docs.columns


def test_jaccard_hot_group(spark):
    """A group larger than the hot limit whose members link through a centre or a few of them only."""
    rng = np.random.default_rng(3)
    base = rng.choice(WORDS, 146)
    texts = [" ".join(f"u{k}_{i}" if rng.random() < 0.001 * (k % 60) else w for i, w in enumerate(base)) for k in range(60)]
    test_jaccard_components(spark, texts)


def test_many_ids_pick_documents_without_moving_them(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 20)
    docs = spark.createDataFrame([(i, f"text {i}") for i in [None, *range(-500, 500)]], "doc_id long, text string")
    wanted = {i for i in range(-500, 500) if i % 3 and i != 64}
    ids = spark.createDataFrame([(i,) for i in sorted(wanted)], "id long")
    for how, expected in (("left_semi", wanted), ("left_anti", {None, *range(-500, 500)} - wanted)):
        picked = jaccard_join._picked(docs, ids, how)
        assert {r[0] for r in picked.collect()} == expected and picked.columns == docs.columns
        assert "SortMergeJoin" not in picked._jdf.queryExecution().executedPlan().toString()


def test_lists_of_the_same_documents_are_told_once(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join([f"first{i}", *words, f"last{i}"])) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hot = jaccard_join._hot(jaccard_join._prefix_tokens(docs, 5, 75), None)
    found = jaccard_join._lists(jaccard_join._index(docs, hot, 5, 75), 75)
    assert found.filter("kind = 2").count() > 50 and found.filter("kind = 1").isEmpty()
    lists = [(r.is_hot, frozenset(r.docs)) for r in found.filter("kind = 2").collect()]
    whole = jaccard_join._whole_lists(found, 75).toPandas()
    assert len(whole[whole.kind == 1]) == sum(len(docs) for _, docs in set(lists)) < sum(len(docs) for _, docs in lists) / 10
    assert {r.component_id for r in jaccard_join.near_duplicate_classes(docs).collect()} == {0}


def test_shingles():
    a, b = shingles.word_hashes(["One two\x0bthree", "x one TWO three y"])
    assert list(a) == list(b[1:4])
    old = shingles.CHUNK
    try:
        shingles.CHUNK = 16
        assert list(shingles.word_hashes(["x one TWO three y" * 5])[0]) == list(shingles._hash_words(("x one two three y" * 5).encode())[0])
    finally:
        shingles.CHUNK = old


def test_repeated_passages(spark, texts):
    rows = substring_dedup.repeated_passages(_docs(spark, texts)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    words = [WORD.findall((t or "").lower()) for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 50):
            seen.setdefault(tuple(w[j : j + 51]), set()).add(i)
    for i, w in enumerate(words):
        want = {k for j in range(len(w) - 50) if len(seen[tuple(w[j : j + 51])]) > 1 for k in range(j, j + 51)}
        assert want <= got.get(i, set())
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(_docs(spark, texts)).collect()}
    assert cut[11] == "" and cut[10] == texts[10]  # the copy goes whole, the first stays


def test_passages_of_several_documents(spark):
    """Every word's smallest holder against brute force; a passage of one document does not drop the words beside it."""
    rng = np.random.default_rng(11)
    new = lambda n: " ".join("v%d" % x for x in rng.integers(0, 1 << 40, n))
    p, q, a, b, rest = (new(n) for n in (60, 60, 70, 80, 90))
    texts = [f"{new(20)} {p} {new(30)}", f"{new(9)} {a}", f"{rest} {p} {q}", f"{rest} {p} {q}", f"{a} {b}", f"{new(5)} {q}", b, f"{rest} {p} {q}", f"{a} {new(30)} {b}"]
    rows = substring_dedup.repeated_passages(_docs(spark, texts)).collect()
    words, seen = [t.split() for t in texts], {}
    for i, w in enumerate(words):
        for j in range(len(w) - 50):
            seen.setdefault(tuple(w[j : j + 51]), set()).add(i)
    want = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 50):
            if len(holders := seen[tuple(w[j : j + 51])]) > 1:
                for k in range(j, j + 51):
                    want[i, k] = min(want.get((i, k), i), *holders)
    got = {}
    for r in rows:
        assert r.n_words == r.end_word - r.start_word and r.drop == (r.first_doc_id < r.doc_id)
        for k in range(r.start_word, r.end_word):
            assert (r.doc_id, k) not in got
            got[r.doc_id, k] = r.first_doc_id
    assert got == want
    cut = {r.doc_id: r.text.split() for r in substring_dedup.cut_repeats(_docs(spark, texts)).collect()}
    kept = {tuple(w[j : j + 51]) for w in cut.values() for j in range(len(w) - 50)}
    for x in (p, q, a, b, rest):
        x = x.split()
        assert {tuple(x[j : j + 51]) for j in range(len(x) - 50)} <= kept


def _shared(x, y):
    """Jaccard similarity of the five-word shingles of two word lists."""
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(one & two) / max(len(one | two), 1)


def test_changed_passages(spark):
    """Passages with changed words in few and in many documents: recall 0.9 and more; a common line is no passage."""
    rng = np.random.default_rng(23)
    new = lambda n: ["q%d" % x for x in rng.integers(0, 1 << 40, n)]
    docs, holders, line = [], {}, new(14)
    for g, (size, changes) in enumerate([(3, 1), (8, 2), (20, 2), (60, 3), (120, 1)]):
        passage = new(90)
        for _ in range(size):
            w = list(passage)
            for k in rng.choice(90, changes, replace=False):
                w[k] = new(1)[0]
            holders.setdefault(g, []).append((len(docs), w))
            docs.append(new(40) + w + new(30))
    clean = range(len(docs), len(docs) + 150)
    docs += [new(60) + line + new(60) for _ in clean]
    rows = substring_dedup.repeated_passages(_docs(spark, [" ".join(w) for w in docs])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for group in holders.values():
        wanted = [(i, w) for i, w in group if any(j < i and _shared(w, v) >= 0.75 for j, v in group)]
        hit = [i for i, _ in wanted if any(r.drop and r.first_doc_id in {j for j, _ in group} and r.n_words >= 51 for r in got.get(i, []))]
        assert len(hit) >= 0.9 * len(wanted)
    assert not [i for i in clean if i in got]
    for i, found in got.items():  # no more than the passage
        assert all(r.start_word >= 40 - 5 and r.end_word <= 130 + 5 for r in found)


def test_compact_windows():
    h = RNG.integers(0, 1 << 62, 300, np.uint64)
    c, low, high = substring_dedup.compact_windows(h, 20)
    want = []
    for i in range(300):
        a = b = i
        while a and h[a - 1] > h[i]:
            a -= 1
        while b < 299 and h[b + 1] > h[i]:
            b += 1
        if b - a + 1 >= 20:
            want.append((i, a, b))
    assert list(zip(c.tolist(), low.tolist(), high.tolist(), strict=True)) == want


def test_mix(spark, texts):
    docs = _docs(spark, texts)
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert sorted((r.doc_id, r.size) for r in rows) == [(i, len(WORD.findall(t or ""))) for i, t in enumerate(texts)]
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.02 * target + 2 * mixing.BLOCK_WORDS
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, rows))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_quality(spark, texts):
    docs = _docs(spark, [*texts, "### *** $$$ %%% " * 40 + _text(60)])
    rows = quality.quality_verdicts(docs).collect()
    for r in rows:
        if r.doc_id == len(texts):
            assert not r.kept
            continue
        t = texts[r.doc_id]
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.keep_quality(docs).columns == docs.columns
    assert {r.doc_id for r in quality.keep_quality(docs).collect()} == {r.doc_id for r in rows if r.kept}


def test_mcd_estimate(spark):
    """Groups with outliers against a search in numpy from many starts: no larger determinant, and the same estimate."""
    rng = np.random.default_rng(1)
    cloud = lambda centre, sd, n: rng.normal(centre, sd, (n, 4))
    groups = {
        "a": np.vstack([cloud((80, 5, 3, 4), (4, 3, 2, 3), 400), cloud((120, 60, 40, 40), 3, 80)]),
        "b": np.vstack([cloud((70, 0, 0, 0), (3, 9, 5, 9), 150), cloud((90, 30, 25, 30), 2, 60)]),
        "c": cloud((60, 2, 1, 1), (5, 1, 1, 2), 40),
    }
    groups = {k: np.maximum(x, 0).round().astype(int) for k, x in groups.items()}
    cells = spark.createDataFrame([("en", k, *map(int, v), 1) for k, x in groups.items() for v in x], "lang string, source string, x0 long, x1 long, x2 long, x3 long, n long")
    cells = cells.groupBy("lang", "source", "x0", "x1", "x2", "x3").agg(F.sum("n").alias("n"))
    target = np.diag(quality.TARGET)

    def step(x, m, c):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = x[d <= np.percentile(d, 100 * quality.COVERAGE)]
        c = np.cov(near.T, bias=True) * quality.CONSISTENCY + target
        return near.mean(0), c, np.linalg.det(c)

    for row in quality.estimates(cells).collect():
        x, found = groups[row.source], []
        for k in range(60):
            m, c, last = (np.median(x, 0) if k == 0 else x[rng.integers(len(x))].astype(float)), target, np.inf
            while True:
                m, c, det = step(x, m, c)
                if not det < last * (1 - quality.SETTLED):
                    break
                last = det
            found.append((det, m, c))
        det, m, c = min(found, key=lambda f: f[0])
        assert row.det <= det * 1.02
        if abs(row.det - det) < 1e-6 * det:
            assert np.allclose([row[f"m{i}"] for i in range(4)], m, rtol=0.02, atol=0.05)
            low = np.linalg.cholesky(c)
            assert np.allclose([row[f"l{i}{j}"] for i in range(4) for j in range(i + 1)], [low[i, j] for i in range(4) for j in range(i + 1)], rtol=0.05, atol=0.05)


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div>"
        "<article><h1>Head &amp; more</h1><p><b>First  paragraph of\nsome length.<br><p>Second &eacute;t&eacute;, longer than the first one by far.</p>"
        "<div class='comments'><p>nice post</p></div></article><footer>&copy; x</footer><script>var t='</p>'</script>"
    )
    assert html_text.main_text(page) == "Head & more\n\nFirst paragraph of some length.\n\nSecond été, longer than the first one by far."
    for odd in (None, "", "<", "<p", "</div>", "<a href='x>y", "<!-- x", "a < b", "<script>x", "<" * 3000, "<div>" * 3000):
        html_text.main_text(odd)
    assert html_text.main_text("plain &amp; text") == "plain & text"


def test_html_boilerplate_without_names():
    text = ["".join(f"Sentence {k} of part {i} tells something new, at some length. " for k in range(6)).strip() for i in range(4)]
    links = "".join(f"<li><a href=/{i}>Page number {i}</a></li>" for i in range(12))
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    want = "\n\n".join(text)
    # link lists, notices and footers in elements that no tag or class tells of
    around = f"<div class=links>{links}</div><ul>{links}</ul><div>We ask for your attention.</div>"
    for page in (
        f"<body>{around}<div class=x>{paragraphs}</div><div>All rights kept, 2024.</div></body>",
        f"<body><table><tr><td>{links}</td><td><div>{paragraphs}</div></td><td>Shop</td></tr></table></body>",
        f"<body>{around}<div><div>{''.join(f'<p>{t}</p>' for t in text[:3])}</div><div><p>{text[3]}</p></div></div></body>",
        f"<body><article>{paragraphs}<ul>{links}</ul></article><div>Short footer</div></body>",
        # wrappers whose class or tag would hide the article
        f"<body><ul>{links}</ul><div class='page with-sidebar side'>{paragraphs}</div></body>",
        f"<body><div class='social widget'><article>{paragraphs}</article></div></body>",
        f"<body><form><ul>{links}</ul><div>{paragraphs}</div></form></body>",
    ):
        assert html_text.main_text(page) == want
    assert html_text.main_text(f"<body><ul>{links}</ul><div id=c><h1>Head</h1><div>{paragraphs}</div></div></body>") == f"Head\n\n{want}"
    listed = f"<body><article>{paragraphs}<ul><li>one</li><li>two</li></ul></article></body>"
    assert html_text.main_text(listed) == f"{want}\n\none\n\ntwo"


@pytest.mark.parametrize("held", [30, 46, 50])
def test_passages_that_the_smallest_document_holds_in_part(spark, held):
    """Passages of 51 words in twenty documents each, of which the smallest has the first words only: none is lost."""
    rng = random.Random(held)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, where = [], {}
    for p in range(12):
        passage = [word() for _ in range(51)]
        for k in range(20):
            lead, tail = [word() for _ in range(rng.randrange(60, 90))], [word() for _ in range(rng.randrange(60, 90))]
            rows.append((100 * p + k, " ".join(lead + passage[: held if k == 0 else 51] + tail)))
            if k:
                where[100 * p + k] = len(lead)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in substring_dedup.repeated_passages(df).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    lost = [d for d, at in where.items() if not any(a <= at and b >= at + 51 for a, b in found.get(d, []))]
    assert lost == [] and all(r % 100 for r in found)


def test_contexts_tell_every_place(spark):
    """Equal words around a minimum at several places of a document count at each of them."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words + [f"m{i}" for i in range(40)] + words))], "doc_id long, text string")
    lists = spark.createDataFrame([(4, 1, 30), (4, 1, 130)], "key long, a long, ca int")
    assert sorted((r.a, low) for r in substring_dedup._contexts(lists, docs).collect() for low in r.lows) == [(1, low) for low in (7, 30, 107, 130)]


def test_html_keeps_what_belongs_to_the_article():
    """Lists, tables, code, short sections, references and formulas beside or inside the main text; not what readers say."""
    text = "A paragraph of ordinary words, that says something about a matter and goes on for about a hundred characters or so."
    p, refs = f"<p>{text}</p>", "".join(f"<li><a href=/{i}>Ref {i}</a></li>" for i in range(5))
    cases = [
        (f"<div>{p * 4}</div><ol><li>Mix the flour.</li><li>Add water.</li></ol><div>{p}</div>", [text] * 4 + ["Mix the flour.", "Add water.", text]),
        (f"<div>{p * 4}</div><table><tr><td>One</td><td>Two</td></tr></table><div>{p}</div>", [text] * 4 + ["One", "Two", text]),
        (f"<div>{p * 4}</div><div><code>x = 1</code></div><div>{p}</div>", [text] * 4 + ["x = 1", text]),
        (f"<div>{p * 5}</div><div><h2>Two</h2><p>A short closing section.</p></div>", [text] * 5 + ["Two", "A short closing section."]),
        (f"<div>{p * 4}</div><h2>Next</h2><div>{p * 2}</div>", [text] * 4 + ["Next", text, text]),
        (f"<article>{p * 4}<h2>References</h2><ul>{refs}</ul></article>", [text] * 4 + ["References"] + [f"Ref {i}" for i in range(5)]),
        (f"<article>{p * 4}<p><a href=a>one link here</a>, <a href=b>another link there</a> and <a href=c>the third</a></p></article>", [text] * 4 + ["one link here, another link there and the third"]),
        (f"<div>{p * 4}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p></div>", [text] * 4 + ["Let x=2 be given."]),
        (f"<article>{p * 5}</article><div id=c>{p}<p>Me too, I think so.</p></div>", [text] * 5),
        (f"<div>{p * 5}</div><div><h3>Replies</h3><p>Me too, I think so.</p></div>", [text] * 5),
        (f"<div>{p * 4}</div><div class='newsletter-signup-box-v2'>{p}</div>", [text] * 4),
        (f"<div>{p * 4}</div><div>Copyright 2020 <a href=/x>Terms</a></div>", [text] * 4),
    ]
    for page, want in cases:
        assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(want)


PARAGRAPHS = [f"Paragraph number {i} with some words that make up a sentence of ordinary length, so it counts." for i in range(6)]


def test_html_names_do_not_drop_articles():
    body, want = "".join(f"<p>{x}</p>" for x in PARAGRAPHS), "\n\n".join(PARAGRAPHS)
    readers = "".join(f'<article class="comment"><p>Reader {i} says that this is very nice indeed and more of that sort please.</p></article>' for i in range(9))
    for page in (
        f'<body><div class="content with-sidebar">{body}</div></body>',
        f'<body><div id="page" class="has-comments">{body}</div></body>',
        f'<body><div class="comments">{body}</div></body>',
        f'<body><article>{body}</article><section id="comments">{readers}</section></body>',
        f'<body><div class="main">{body}</div><div class="commentList">{readers}</div><div class="cookie-notice">We use cookies.</div></body>',
        f'<body><div class="site-header">The site</div><article>{body}<div class="share-buttons">Share this now</div></article></body>',
        f"<body><form action=x>{body}<input name=q></form></body>",
        "<body>" + "<div>" * 400 + body + "</div>" * 400 + "</body>",
    ):
        assert html_text.main_text(page) == want
    related = "<section id='related-work'><p>Related work is discussed at length in this section.</p></section><p class='share-price'>The share price rose by ten percent on Monday.</p>"
    assert html_text.main_text(f"<body><article>{body}{related}</article></body>").endswith("in this section.\n\nThe share price rose by ten percent on Monday.")
    assert html_text.main_text(f"<body><p title='a<b>c'>{want}</p><p>5 < 6 and a&lt;b</p></body>").endswith("5 < 6 and a<b")


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<p>", "<b>", "<", "<!--", '<a "', "<a '>", "<svg>", "<li><ul>", "</b>", "<b><p>", "</script", "&amp;"])
def test_html_time_grows_with_length(unit):
    took = []
    for size in (150_000, 600_000):
        page = unit * (size // len(unit))
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5  # four times the length


def test_html_densities():
    """Every node's counts and density against their definition, node by node."""
    page = "<div>a b<p>text <a href=x>link</a> more</p><ul><li><a>x</a></li><li>yy</li></ul></div><p>last words here</p>"
    root = html_text.parse(page)
    html_text.measure(root)

    def count(node, in_link):
        c, t, lc, lt = 0, 0, 0, 0
        for x in node.items:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                c, lc = c + n, lc + n * in_link
            else:
                more = count(x, in_link or x.tag == "a")
                c, t, lc, lt = c + more[0], t + more[1] + 1, lc + more[2], lt + more[3] + (x.tag == "a")
        return c, t, lc, lt

    whole = count(root, False)
    stack = [(root, False)]
    while stack:
        node, in_link = stack.pop()
        c, t, lc, lt = count(node, in_link)
        assert (node.chars, node.tags, node.link_chars, node.links) == (c, t, lc, lt)
        assert node.density == pytest.approx(html_text._density(c, t, lc, lt, whole[2] / whole[0]))
        children = [x for x in node.items if not isinstance(x, str)]
        assert node.sum == pytest.approx(sum(x.density for x in children))
        stack += [(x, in_link or x.tag == "a") for x in children]


def test_extract_odd_tables(spark):
    """Empty tables, repeated rows, columns with the result's names, a very long page."""
    html = "<body>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS) + "</body>"
    long = "<body><article>" + "<p>word and word in a long line of text</p>" * 20_000 + "</article></body>"
    pages = spark.createDataFrame([(1, "u", html, "t", 7)] * 2 + [(None, None, "", None, None), (4, "", long, "x", 1)], "page_id long, url string, html string, text string, n_chars long")
    assert html_text.extract(pages.filter("false")).count() == 0
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, len("\n\n".join(PARAGRAPHS))), (1, len("\n\n".join(PARAGRAPHS))), (4, 20_000 * 38 - 2)]


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>text one</p>"), (2, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).orderBy("page_id").collect()] == [(1, "text one", 8), (2, "", 0)]


FUZZ = ["a", "b,", "É", "Ébc.", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "<|endoftext|>", "&", " ", "\x1c", "ß", "İ", "Σ", "日本", "́", "\0", "word12", "x...", "µ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(FUZZ, rng.integers(0, 14))) for _ in range(4000)]
    e = tokens.Encoder(common.tokenizer_path(name))
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_store_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    folder = common.new_folder(spark, "store")
    manifest = token_store.write_store(_docs(spark, texts), folder, path)
    rows = sorted(token_store.read_store(manifest).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    reader = token_store.ShardReader(manifest.first().path)
    assert reader.find(3)[0].tolist()[-1] == 2 and reader.find(10**9) == []


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack(_docs(spark, texts)).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, 2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(ids[j : j + 2048] for j in range(0, len(ids), 2048))]
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 1


def test_plan_uses_complements():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 30, 50, 20, 100]] = [3, 1, 1, 1, 1, 2]
    plan = packing.Plan(counts, 100)
    assert sum(t for _, t in plan.patterns) == 6  # 100, 100, 60+40, 60+.., 60+.., 50+..
    assert sum(t * sum(p) for p, t in plan.patterns) == int((np.arange(101) * counts).sum())


def test_license_scan(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "Nothing here.", None, "Licensed under CC BY-NC 4.0."]
    docs = _docs(spark, [*(f"{_text(20)}\n{x}" if x else x for x in lines), *(_text(30) for _ in range(60))])
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(6)] == [("apache-2.0", True), ("mit", True), ("unknown", False), ("none", False), ("none", False), ("cc-by-nc-4.0", True)]
    assert all(got[i][0] == "none" for i in range(6, 66))


def test_license_scan_wrapped(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License"
    mit = " * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and\n * associated documentation files"
    prose = [f"{_text(12)}\nThe film was {a} in May and {b} in\n{c} cinemas {_text(4)}" for a in ("released", "granted") for b in ("distributed", "permitted") for c in ("free", "all")]
    texts = [f"{_text(9)}\n\n{bsd}\n\n{_text(9)}", f"#!/bin/x\n#\n{gpl}\n#\n{_text(9)}", f"/*\n{mit}\n */\n{_text(9)}", f"{_text(9)}\n{bsd}\n{_text(9)}"]
    got = {r.doc_id: (r.family, r.confirmed, r.line) for r in license_scan.scan(_docs(spark, [*texts, *prose, *(_text(30) for _ in range(40))])).collect()}
    assert [got[i][:2] for i in range(4)] == [("bsd", True), ("gpl-3.0", True), ("mit", True), ("bsd", True)]
    assert [got[i][2] for i in range(4)] == [2, 2, 1, 0]
    assert {got[i][0] for i in range(4, 52)} == {"none"}


def test_license_unseen_families(spark):
    """Left-out phrases, names and families: most notices are named, most of unseen families not; ties and odd texts."""
    docs = _docs(spark, [_text(40) for _ in range(40)])
    rows, words = license_scan.labelled(docs)
    assert {"license", "licensed", "mozilla"} <= set(words)
    predictions = license_scan.left_out(rows)
    limit, right, apart = license_scan.calibrated(predictions)
    assert 0.3 <= limit <= 0.99 and apart >= 0.9 and right >= 0.85
    told = {r.family: r for r in license_scan.by_family(predictions, limit).collect()}
    assert set(told) == set(license_scan.NAMES) and all(r.recall >= 0.75 and r.precision >= 0.7 for r in told.values())
    notice = "Released under the MIT License."
    texts = [f"{notice}\n{notice}", "", None, f"{_text(20_000)}\n{notice}", notice + " x" * 3]
    got = {r.doc_id: r for r in license_scan.scan(_docs(spark, [*texts, notice, notice])).collect()}
    assert [got[i].family for i in (0, 1, 2, 3, 4, 5, 6)] == ["mit", "none", "none", "mit", "mit", "mit", "mit"]
    assert got[0].line == 0 and got[0].n_paragraphs == 2


def test_license_learns_from_all_texts(spark, monkeypatch):
    """Every text of the corpus counts, for the telling words and as an ordinary use, whatever its number."""
    monkeypatch.setattr(license_scan, "SAMPLE_DOCS", 5, raising=False)
    monkeypatch.setattr(license_scan, "NEGATIVES", 4)
    uses = [f"The expat number {i} of the town met {chr(97 + i)} friends." for i in range(20)]
    docs = _docs(spark, [*uses, *uses[:3], *(f"Mozilla meeting {i}." for i in range(40)), "\n".join(f"line {i}" for i in range(45_000))])
    rows, words = license_scan.labelled(docs)
    assert "expat" in words and "mozilla" not in words  # 20 and 40 of 45,060 distinct lines; the share is 0.0005
    of_corpus = rows.filter("template = -1").agg(F.sum("texts"), F.sum("weight")).first()
    assert of_corpus[0] == 20 and of_corpus[1] == pytest.approx(4)


def test_license_in_other_words(spark):
    """Notices that are not in the module's words; licences that are of no listed family."""
    named = {
        "// Licensed under the MIT license. See LICENSE in the project root.": "mit",
        "Copyright (c) 2011 X. Released under the BSD 3-Clause license.": "bsd",
        "You may choose the Mozilla Public License 2.0 for this file.": "mpl-2.0",
        "Code in this tree is covered by the Apache License, Version 2.0": "apache-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.": "unknown",
        "Licensed under the Frobnicate Public License, version 4.": "unknown",
        "She studied at the institute and got leave to fish.": "none",
    }
    docs = _docs(spark, [*named, *(_text(40) for _ in range(40))])
    got = {r.doc_id: r.family for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(named))] == list(named.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_lm_scores_do_not_depend_on_layout(spark, monkeypatch, parts):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 12_000)  # several chunks
    rng = np.random.default_rng(2)
    docs = _docs(spark, [_text(int(n), rng) for n in rng.integers(1, 200, 120)], extra=False)
    rows = {r.doc_id: r.score for r in lm_score.score_documents(docs.repartition(parts)).collect()}
    again = {r.doc_id: r.score for r in lm_score.score_documents(docs.coalesce(2)).collect()}
    assert rows == pytest.approx(again, abs=1e-6)


def test_lm_learns(spark):
    """Held-out texts of a regular language score better than by their words' frequencies alone."""
    rng = np.random.default_rng(6)
    follow = {w: [f"k{(i * 7 + d) % 60}" for d in range(3)] for i, w in enumerate(f"k{j}" for j in range(60))}

    def sentence():
        w = [f"k{rng.integers(60)}"]
        while len(w) < 120:
            w.append(follow[w[-1]][rng.integers(3)])
        return " ".join(w)

    rows = lm_score.score_documents(_docs(spark, [sentence() for _ in range(400)], extra=False)).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_lm_scores(spark, texts):
    many = [*texts, *(_text(60) for _ in range(150))]
    rows = lm_score.score_documents(_docs(spark, many)).collect()
    words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [""] for t in many]
    counts = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(many)
    for r in rows:
        ws = words[r.doc_id]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base) and np.isfinite(r.score) and r.score < 0


def test_recurrent_gradient_and_mass():
    shape = recurrent.Shape(40, 3)
    flat = shape.start(np.arange(1, 44)).astype(np.float64)
    symbols, starts, lengths = np.array([3, 41, 7, 0, 39, 42, 5], np.uint16), np.array([0]), np.array([7])
    v, g = shape.views(flat), np.zeros_like(flat)
    steps = next(recurrent._windows(symbols, starts, lengths))
    recurrent._gradient(shape, v, shape.views(g), np.zeros((1, recurrent.HIDDEN)), steps)
    loss = lambda f: -recurrent.score(shape, f, 0.0, symbols, starts, lengths)[0]
    used = np.flatnonzero(np.abs(g) > 1e-4)[::37]
    for k in used:
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g[k], rel=2e-2, abs=1e-4)
    one = [np.exp(recurrent.score(shape, flat, 0.0, np.array([s], np.uint16), np.array([0]), np.array([1]))[0]) for s in range(43)]
    assert sum(one) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(
    "run",
    [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, jaccard_join.near_duplicate_classes, mixing.mix_plan, mixing.mix_documents, quality.quality_verdicts, quality.keep_quality, packing.pack, substring_dedup.repeated_passages, license_scan.scan, lm_score.score_documents],
)
def test_empty_table(spark, run):
    assert run(_docs(spark, ["x"]).filter("false")).count() == 0


VERY_LONG = ("word " * 60_000).strip(), "x" * 400_000, "\n".join(f"line {i} of many" for i in range(40_000))


@pytest.mark.parametrize(
    "run",
    [exact_dedup.exact_groups, jaccard_join.near_duplicate_classes, mixing.mix_plan, quality.quality_verdicts, packing.pack, substring_dedup.repeated_passages, substring_dedup.cut_repeats, license_scan.scan, lm_score.score_documents],
)
def test_very_long_texts(spark, run):
    assert run(_docs(spark, [*VERY_LONG, VERY_LONG[0]])).count() >= 2


def test_long_texts_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_store.token_files(spark, _docs(spark, list(VERY_LONG))).collect()}
    for i, t in enumerate(VERY_LONG):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_unknown_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, "?"))
    made.pre_tokenizer = pre_tokenizers.Split("-", "removed")
    made.save(f"{tmp_path}/t.json")
    encode = tokens.Encoder(f"{tmp_path}/t.json")
    assert not encode.cuts and [np.frombuffer(x, "<u4").tolist() for x in encode.encode(["a b-a", "b"])] == [[0, 1], [2]]


def test_shards_of_one_id(spark):
    """An id with most rows is spread over shards; order and starts hold."""
    docs = _docs(spark, [_text(30) + f" {i}" for i in range(90)], extra=False).withColumn("doc_id", F.when(F.col("doc_id") < 80, F.lit(7)).otherwise(F.col("doc_id")).cast("long"))
    old = token_store.MIN_SHARD_CHARS
    try:
        token_store.MIN_SHARD_CHARS = 1_000
        folder = common.new_folder(spark, "shards")
        manifest = token_store.write_store(docs, folder, common.tokenizer_path("byte_bpe_50k.json"))
        assert manifest.filter("docs > 0").count() > 5
        rows = token_store.read_store(manifest).collect()
    finally:
        token_store.MIN_SHARD_CHARS = old
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [7] * 80 + list(range(80, 90))


def test_passages_with_odd_ids(spark):
    """Null ids take no part; columns with the operator's names stay out of its way."""
    same = _text(80)
    docs = _docs(spark, [same, same, f"{same} more"], extra=False).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))).withColumns({"start_word": F.lit(1), "n": F.lit(2), "partner": F.lit("p")})
    assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == {1, 2}
    assert substring_dedup.cut_repeats(docs).columns == docs.columns


def test_empty_store(spark):
    assert token_store.token_files(spark, _docs(spark, ["x"]).filter("false")).count() == 0


def test_null_ids(spark):
    docs = _docs(spark, ["a b", "a b", _text(70)]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {r.keep_id for r in exact_dedup.exact_groups(docs).filter("group_size = 2").collect()} == {1}
    assert {r.component_id for r in jaccard_join.near_duplicate_classes(docs).collect()} == {1, 2}
    for run in (mixing.mix_plan, quality.quality_verdicts, packing.pack, license_scan.scan, lm_score.score_documents):
        assert run(docs).count() >= 3
    assert token_store.token_files(spark, docs).count() == 3


def test_pipeline_stages(spark, texts):
    import corpus_pipeline

    docs = _docs(spark, texts, extra=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stage(stage(spark, docs, ""), name)
        assert out.columns == docs.columns
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
