"""Quality rules, classifier, pages, templates, shards, the pipeline and the registered queries."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tablewatch.llm import html_text, lookup_sharding, quality_model, quality_rules, templates
from tablewatch.llm.doc_stats import doc_counts
from tablewatch.llm.shared import bounded, table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_words STRING, group STRING, bin STRING, distance STRING"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "a", "b", "c", "d") for i, t, lang, src in rows], DOCS)


def base_statistics(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_quality_rules(spark):
    pick = random.Random(1)
    vocabulary = ["".join(pick.choice("aeioustnr") for _ in range(pick.randint(3, 7))) for _ in range(400)]
    prose = lambda: " ".join(pick.choice(vocabulary) for _ in range(pick.randint(60, 200)))
    rows = [(k, prose(), "en", "a") for k in range(300)]
    junk = [(1000 + k, " ".join(w.upper() + "###$$$" for w in prose().split()), "en", "a") for k in range(20)]
    odd = [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "é x\x0bé\n\né x\x0bé", None, None), (None, prose(), None, "a"), (0, rows[0][1], "en", "a"), (2003, "loop the loop " * 40, "en", "a")]
    got = quality_rules.judge(frame(spark, rows + junk + odd)).collect()
    assert len(got) == len(rows + junk + odd)
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows + junk + odd:
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_statistics(text or "")
    assert not any(by_id[i].kept for i, *_ in junk) and not by_id[2003].kept
    assert all(by_id[i].kept for i, *_ in rows)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_concentration_finds_the_clean_part(spark):
    """With a fifth of the rows far away, the estimate is that of the others."""
    pick = np.random.default_rng(2)
    clean = " ".join(["stone", "river", "cloud"] * 40)
    rows = [(k, " ".join(clean.split()[: int(n)]) + f" {k}", "en", "a") for k, n in enumerate(pick.integers(60, 120, 200))]
    rows += [(1000 + k, clean + " $$$ %%% ###" * 60, "en", "a") for k in range(50)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    far = [got[i].distance for i in range(1000, 1050) if got[i].distance is not None]
    near = [got[i].distance for i in range(200) if got[i].distance is not None]
    assert not far or min(far) > max(near)


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = scored.join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_rows(spark):
    docs = frame(spark, [(1, None, "en", "a"), (2, "", None, None), (None, "words", "en", "a"), (2, "", None, None)])
    none = spark.createDataFrame([(7, None), (None, 1)], "doc_id LONG, quality INT")
    got = quality_model.classify(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 4 and all(r.predicted == 1 for r in got)
    assert quality_model.classify(frame(spark, []), none).count() == 0


def test_trees_equal_a_walk_node_by_node():
    pick = np.random.default_rng(3)
    x = pick.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = quality_model.fit(x, y, trees=20, depth=3)
    score = trees.score(x)
    assert ((score > 0.5) == (y == 1)).mean() > 0.97
    for row, own in zip(x[:50], score[:50], strict=True):
        total = trees.base
        for feature, limit, value in zip(trees.feature, trees.limit, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        assert own == pytest.approx(1 / (1 + np.exp(-total)))


def test_counts_do_not_depend_on_blocks(spark):
    texts = [(k, "a b c\n" * k, "en", "a") for k in range(50)]
    one = {r.doc_id: r for r in doc_counts(frame(spark, texts)).collect()}
    for k, text, *_ in texts:
        alone = doc_counts(frame(spark, [(k, text, "en", "a")])).first() if k in (0, 1, 49) else one[k]
        assert one[k] == alone


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><main><h1>T</h1><p>one <b>two</b>\n three<br>four<p>five &amp; six</main><footer>f</footer>", "T\none two three four\nfive & six"),
        ('<div class="post"><p>body text</p></div><div id="comments"><p>hey</p></div><aside>s</aside>', "body text"),
        ("<article><script>var x = '<p>'</script><style>p{}</style><p>a</p><form>f</form></article>", "a"),
        ('<div class="cookie-notice">c</div><div class="adBox ad">x</div><p>real</p>', "real"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>" + "long " * 9 + "</p></div>", ("long " * 9).strip()),
        ('<p title="a>b">q</p><!-- <p>no</p> --><p hidden>h</p>', "q"),
        ("", ""), ("plain", "plain"), ("<div>" * 3000 + "deep", "deep"), ("<a '<b", "<a '<b"),
    ],
)
def test_main_text_of_a_page(html, text):
    assert html_text.main_text(html_text.parse(html), None) == text


LONG = "words of an article " * 20
WHOLE = LONG.strip()


@pytest.mark.parametrize("html,text", [
    (f"<div>a b</div><article><h1>The title</h1><p>The lead</p><div class=body>{LONG}</div></article>", f"The title\nThe lead\n{WHOLE}"),
    (f"<article><p>intro</p><ul><li>{LONG}</li></ul><p>outro</p></article>", f"intro\n{WHOLE}\noutro"),
    (f'<div class="content no-sidebar"><p>{LONG}</p></div>', WHOLE),
    (f'<div class="post share-enabled"><p>{LONG}</p></div>', WHOLE),
    (f"<form id=aspnetForm><div><p>{LONG}</p><form><p>search</p></form></div></form>", WHOLE),
    (f'<p>{LONG}</p><form><p>leave a reply</p></form><div class="comment-list"><p>nice</p></div><div class="sidebar"><p>more</p></div>', WHOLE),
    (f"<div><h1>Title</h1><div><p>{LONG}</p></div></div>", f"Title\n{WHOLE}"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>See also this</a></li></ul></article>", f"{WHOLE}\nSee also this"),
])
def test_article_text_stays(html, text):
    assert html_text.main_text(html_text.parse(html), None) == text


def test_a_hosts_path_that_leaves_text_out_gives_way():
    html = f'<article><div class=body><p>{LONG}</p></div><div class=more><p>{LONG}</p></div></article>'
    assert html_text.main_text(html_text.parse(html), ">article>div.body") == f"{WHOLE}\n{WHOLE}"


def test_deep_pages_take_linear_time():
    page = html_text.parse("<div>" * 20_000 + f"<h1>T</h1><p>{LONG}</p>")
    assert html_text.main_text(page, None) == f"T\n{WHOLE}"


def test_hosts_vote(spark):
    page = lambda body: f"<body><div class=wrap1>{body}</div><div class=more>teaser</div></body>"
    usual = "<section class=story><p>" + "story words " * 20 + "</p></section>"
    rows = [(k, "http://h.org/1", page(usual), "w") for k in range(6)]
    rows += [(10, "http://h.org/2", page(usual.replace("words " * 1, "words ", 1) + "<p>" + "outside " * 40 + "</p>"), "w")]
    rows += [(11, None, None, "w"), (12, "http://h.org/3", "", "w"), (None, "//other", "<p>x</p>", "w")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, winner STRING")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[0].text == got[5].text == ("story words " * 20).strip() and got[0].n_chars == 239
    assert got[11].text == got[12].text == "" and got[None].text == "x"
    winners = {r.host: r.winner for r in html_text.consensus(pages).collect()}
    assert winners["h.org"] == ">body>div.wrap#>section.story"
    assert html_text.extract(pages.limit(0)).count() == 0


ITEM = "A train left Paris at 9 km per hour and a second train left Rome at 12 km per hour when do both trains meet"


def template_rows(spark, docs):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "too short", "x"), (3, None, "x"), (None, ITEM, "x")], "item_id LONG, text STRING, window STRING")
    rows = spark.createDataFrame([(i, t, "p") for i, t in docs], "doc_id LONG, text STRING, pos STRING")
    return templates.contaminated(rows, items)


def test_templates_catch_new_values_and_reject_mixed_ones(spark):
    changed = ITEM.replace("Paris", "Lyon").replace("Rome", "Milan").replace(" 9 ", " 40 ").replace("12", "55").replace("km", "miles")
    mixed = changed.replace("55 miles", "55 feet")
    pad = "plain prose before it and more of it. "
    docs = [
        (1, pad + ITEM + ". And after."), (2, pad + changed), (3, pad + mixed), (4, pad * 30), (5, None), (6, ""),
        (7, pad + ITEM.upper().lower()), (8, "too short"), (None, ITEM), (9, ITEM[:40]), (1, pad + ITEM + ". And after."),
    ]
    got = {(r.doc_id, r.item_id) for r in template_rows(spark, docs).collect()}
    assert got >= {(1, 1), (2, 1), (8, 2)}
    assert not {d for d, _ in got} & {3, 4, 5, 6, 9, None}
    assert template_rows(spark, []).count() == 0


PAD = "plain prose before it and more of it. "


def reported(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id LONG, text STRING")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id LONG, text STRING")
    return {(r.doc_id, r.item_id) for r in templates.contaminated(rows, items).collect()}


def test_template_words_need_no_pattern_each(spark):
    """Marks at a word's end are trimmed; the window's second key is there only if it holds a name."""
    rows = spark.createDataFrame([(1, "then Anna went home?! now it rains a lot.")], "doc_id LONG, text STRING")
    windows = templates.windows(rows, "doc_id")
    assert [r.folded is not None for r in windows.orderBy("pos").collect()] == [True, True, False, False, False]
    assert "regexp_replace" not in windows._jdf.queryExecution().optimizedPlan().toString()


def test_template_windows_are_hashed_in_generated_code(spark):
    """What is done for each window is no function of a list, which Spark evaluates step by step."""
    rows = spark.createDataFrame([(1, "then Anna paid 5 km."), (2, "THEN anna paid +7 km Word!"), (3, "<b> 1 2 $3 km"), (4, "5 km"), (5, "")], "doc_id LONG, text STRING")
    windows = templates.windows(rows, "doc_id")
    steps = [s for s in windows._jdf.queryExecution().executedPlan().toString().split("\n") if " AS window" in s]
    assert len(steps) == 1 and "*(" in steps[0] and "xxhash64" in steps[0] and "lambda" not in steps[0]
    got = {(r.id, r.pos): r for r in windows.collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (3, 0), (4, 0)}
    assert got[1, 0].folded == got[2, 0].window != got[1, 0].window and got[1, 0].own != got[2, 0].own
    assert [k for k, r in got.items() if r.bare] == [(3, 0), (4, 0)]


def test_templates_compare_aligned_slots_only(spark):
    """Rows of numbers and names repeat their windows; a copy, verbatim or with new values, is consistent all the same."""
    items = [
        "which of these is the sum of all A) 12 B) 15 C) 18 D) 21",
        "find what comes next in the series 2, 4, 6, 8, 10, 12, 14",
        "we met Anna Berta Carla Dora Emma Frida Greta at noon",
    ]
    changed = items[1].replace("2, 4, 6, 8, 10, 12, 14", "3, 5, 7, 9, 11, 13, 15")
    got = reported(spark, items, [*(PAD + t for t in items), PAD + changed])
    assert got >= {(0, 0), (1, 1), (2, 2), (3, 1)}


def test_templates_find_parts_split_copies_and_other_case(spark):
    plain = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    sixty, long = plain[:60], plain[60:]
    named = [w.title() if k % 5 == 2 else w for k, w in enumerate(plain[100:130])]
    docs = [
        sixty[10:38], [*sixty[:30], *["filler"] * 20, *sixty[30:]], long[50:190], [w.upper() for w in named], [w.lower() for w in named],
        sixty[:10], [*sixty[:6], "x", *sixty[6:12]],
    ]
    got = reported(spark, [" ".join(sixty), " ".join(long), " ".join(named)], [PAD + " ".join(d) for d in docs])
    assert got >= {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)}
    assert not {d for d, _ in got} & {5, 6}


def test_many_matches_are_not_broadcast(spark, monkeypatch):
    """Files of matches are tiny beside their rows: counted rows, not Spark's guess from the files, say what the driver holds."""
    items = spark.createDataFrame([(1, "the train leaves at 9 and comes back at 12 with 40 people from the north")], "item_id LONG, text STRING")
    rows = [(k, f"see {k} how the train leaves at {k} and comes back at 12 with 40 people from the north") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    want = templates.contaminated(docs, items).collect()
    monkeypatch.setattr(templates, "MAX_BROADCAST_MATCHES", 100, raising=False)  # there are some hundred matches
    found = templates.contaminated(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[doc_id#\d+L, pos#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[doc_id#\d+L, pos#\d+\]", plan)
    assert len(want) == 60 and sorted(found.collect()) == sorted(want)
    assert "strategy=merge" in bounded(docs, 59)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in bounded(docs, 60)._jdf.queryExecution().analyzed().toString()


def test_templates_find_every_whole_item(spark):
    sf = "/root/testdata/sf0.01"
    one_line = lambda t: " ".join(t.split())
    docs = [(r.doc_id, one_line(r.text)) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, one_line(r.text)) for r in table(spark, sf, "benchmark").collect()]
    whole = {(d, i) for i, t in items for d, text in docs if t in text}
    found = templates.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == whole


def test_lookup_table_by_claims_in_turn():
    names = [f"s{k}" for k in range(7)]
    owner = lookup_sharding.lookup_table(names, 101)
    sizes = Counter(owner.tolist())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = lookup_sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 35
    orders = []
    for n in names:
        offset, step = lookup_sharding._hash(f"{n}/offset") % 101, lookup_sharding._hash(f"{n}/step") % 100 + 1
        orders.append([(offset + k * step) % 101 for k in range(101)])
    free, claims = set(range(101)), {}
    while free:
        for k, order in enumerate(orders):
            if free:
                slot = next(s for s in order if s in free)
                free.remove(slot)
                claims[slot] = k
    assert [claims[s] for s in range(101)] == owner.tolist()
    with pytest.raises(ValueError, match="prime"):
        lookup_sharding.lookup_table(names, 100)


def test_placement_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("", "z")], "k STRING, slot STRING")
    got = lookup_sharding.place(rows, "k", ["one", "two"], 11).collect()
    assert len(got) == 4 and got[0].shard == got[1].shard and got[2].slot == got[3].slot
    owner = lookup_sharding.lookup_table(["one", "two"], 11)
    assert all(r.shard == ["one", "two"][owner[lookup_sharding._hash(r.k or "") % 11]] for r in got)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontamination", "pieces"]
    rejected = {r.doc_id for r in quality_model.classify(docs, table(spark, SF, "labels")).where("predicted = 0").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    lined = corpus_pipeline.lines(spark, kept, SF)
    assert lined.columns == docs.columns and lined.count() == kept.count()
    seen = Counter(line for r in lined.collect() for line in r.text.split("\n") if re.search(r"[^\W_]", line))
    assert max(seen.values()) == 1
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in kept.collect()}
    assert len({r.doc_id for r in final}) == len(final) > 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert "pipeline" in names
