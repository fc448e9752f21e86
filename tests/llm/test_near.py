"""Near-duplicate documents and lines against all pairs."""

import contextlib
import io
import random
import re
from itertools import combinations

import pyarrow as pa
import xxhash

from tablewatch.llm import line_dedup, near_dedup, queries
from tablewatch.llm.shared import components

EXTRA = "doc_id LONG, text STRING, node STRING, component STRING, key STRING, kept STRING, n_chars LONG"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "c", "k", "x", 7) for i, t in rows], EXTRA)


def smallest(nodes, links):
    """Smallest member of each node's component."""
    own = {n: n for n in nodes}

    def root(n):
        while own[n] != n:
            n = own[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        own[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def corpus(seed=1):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[pick.choice(vocabulary) for _ in range(pick.randint(8, 60))] for _ in range(60)]
    rows, k = [], 0
    for words in base:
        for _ in range(pick.choice([1, 1, 2, 4])):
            copy = list(words)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    # a group of many variants
    long = [pick.choice(vocabulary) for _ in range(120)]
    for v in range(150):
        rows.append((k + v, " ".join([*long[: v % 118], f"v{v}", *long[v % 118 :]])))
    return rows


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = components(spark.createDataFrame(edges, "x LONG, y LONG"), "x", "y").collect()
    nodes = {n for e in edges for n in e} - set()
    assert {r.node: r.component for r in got} == smallest(nodes, edges)
    assert components(spark.createDataFrame([], "x LONG, y LONG"), "x", "y").count() == 0


def test_few_edges_go_into_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(k, k + 1 + k % 3) for k in range(0, 8000, 4)], "x LONG, y LONG")
        out = components(edges, "x", "y")
        assert out.count() == 4000
        assert len(out.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def check_near(spark, rows, size):
    got = near_dedup.near_duplicates(frame(spark, rows), size=size, percent=80).collect()
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    assert len(got) == len(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_equal_all_pairs(spark):
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "ONE TWO"), (9007, "two one"), (9008, "É é"), (9009, "é É")]
    check_near(spark, corpus() + odd, 2)


def test_near_duplicates_of_five_words_and_empty_tables(spark):
    check_near(spark, corpus(2)[:90], 5)
    assert near_dedup.near_duplicates(frame(spark, []), 5).count() == 0
    rows = frame(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")])
    assert [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(rows, 2).distinct().collect()] == [(1, 1)]


def test_nodes_that_branch_to_the_last_level(spark, monkeypatch):
    """Groups above the size of a node that branches again, at every level."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    check_near(spark, corpus(3), 2)


def test_a_set_branches_from_all_its_nodes_at_once():
    """One row with a list of nodes has the children of its nodes; members carry what they are compared by."""
    held = {k: pa.array([j + 1, j + 2]) for j, k in enumerate(near_dedup.HELD)}
    mins = pa.array([bytes(range(256)), bytes(reversed(range(256)))], pa.binary())

    def children(*lists):
        batch = pa.RecordBatch.from_pydict({"nodes": pa.array(lists, pa.list_(pa.int64())), **held, "mins": mins})
        (out,) = near_dedup._branch(iter([batch]), 1, 1)
        assert out.schema.names == ["node", *near_dedup.HELD]
        return sorted(map(str, out.to_pylist()))

    assert children([5, -6], [7]) == sorted(children([5], [7]) + children([-6], []))


def test_ids_with_two_texts(spark):
    """Each text of an id keeps its links, and repeated rows change nothing."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = frame(spark, [(5, a), (5, b), (5, b), (7, a + " more"), (8, b + " more"), (9, "other words")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows, 2).collect())
    assert got == [(5, 5, True)] * 3 + [(7, 5, False), (8, 5, False), (9, 9, True)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_rows(spark):
    rows = frame(spark, [(1, None), (None, "one line\none line"), (2, "one line\none line\n")])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {1: None, None: "one line\none line", 2: "one line\n"}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b\na b", 7, "x", 3), (None, None, 8, "y", None)], "doc_id LONG, text STRING, kept_id INT, kept_lines STRING, kept_0 INT")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "a b", 7, "x", 3), (None, None, 8, "y", None)]


def simhash(words):
    """128 bits, each the majority in the hashes of the different long words; the second half hashes the first one's hash."""
    long = [w for w in words if len(w) >= 4]
    votes, words = [0] * 128, set(long if len(long) >= 4 else words)
    for word in words:
        a = xxhash.xxh64(word.encode(), seed=42).intdigest()
        b = xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()
        for k in range(64):
            votes[k] += a >> k & 1
            votes[64 + k] += b >> k & 1
    return sum(1 << k for k in range(128) if 2 * votes[k] > len(words))


def share_a_block(a, b, width):
    def block(x, at):
        return (x >> at | x << 128 - at) & (1 << width) - 1

    return (a ^ b).bit_count() <= 40 and any(block(a, at) == block(b, at) for at in range(0, 128, 16))


def kept_by_all_pairs(rows, width):
    """Kept lines if all pairs are compared: by SimHash blocks and edits, and how many of the pairs alike by edits meet."""
    places = {}
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            places.setdefault(tuple(re.findall(r"[^\W_]+", line.lower())), []).append((i, k))
    blank = set(places.pop((), []))
    first = {w: min(p) for w, p in places.items()}
    hashes = {w: simhash(w) for w in first}
    alike = [
        (a, b) for a, b in combinations(first, 2)
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-6 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6
    ]
    links = [(first[a], first[b]) for a, b in alike if share_a_block(hashes[a], hashes[b], width)]
    groups = smallest(first.values(), links)
    kept = {p for p, g in groups.items() if p == g} | blank
    return {i: [k for k in range(text.count("\n") + 1) if (i, k) in kept] for i, text in rows}, len(links), len(alike)


def changed(pick, base, share, vocabulary):
    words = list(base)
    for _ in range(max(1, int(share * len(base)))):
        at = pick.randrange(len(words))
        how = pick.choice(["put", "cut", "add"])
        if how == "cut" and len(words) > 1:
            del words[at]
        elif how == "add":
            words.insert(at, pick.choice(vocabulary))
        else:
            words[at] = pick.choice(vocabulary)
    return words


def test_lines_equal_all_pairs(spark):
    """Lines of every short length, up to a fifth of the words changed: the links of all pairs that share a block."""
    pick = random.Random(8)
    vocabulary = [f"{'long' * pick.randint(0, 3)}w{k}" for k in range(300)]
    rows = [(900, ""), (901, "same words here"), (902, "Same, words -- HERE!\n\n--"), (903, "x" * 70_000)]
    for n in [*range(1, 26), 30, 37, 50, 80, 127, 128, 300]:
        base = [pick.choice(vocabulary) for _ in range(n)]
        rows += [(len(rows), " ".join(changed(pick, base, share, vocabulary))) for share in (0, 0.03, 0.05, 0.1, 0.2, 0.25)]
    want, n_links, n_alike = kept_by_all_pairs(rows, line_dedup.block_width(len(rows)))
    assert 60 < n_links < n_alike
    assert {r.doc_id: r.kept for r in line_dedup.kept_lines(frame(spark, rows)).collect()} == want


def test_recall_of_lines_by_edits_alone(spark):
    """Of pairs with one word in twenty changed, as many as the docstring says are found."""
    pick = random.Random(9)
    vocabulary = [f"word{k}" for k in range(5000)]
    rows = []
    for k in range(400):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([20, 40, 60, 100]))]
        copy = list(base)
        for at in range(10, len(base), 20):
            copy[at] = pick.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    dropped = [r.doc_id for r in line_dedup.kept_lines(frame(spark, rows)).where("size(kept) = 0").collect()]
    assert all(k % 2 for k in dropped) and len(dropped) >= 0.9 * 400


def anchored_keys(words):
    """The keys of the queries by another way: the block's bits and the three words whose hashes come first for the key."""
    long = list(dict.fromkeys(w for w in words if len(w) >= 4))
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in (long if len(long) >= 4 else dict.fromkeys(words))]
    whole = simhash(words)
    first = [min((h ^ k << 61 ^ 1 << 63 for h in hashes)) >> 32 for k in range(8)]  # in the order of signed numbers
    return {(k, (whole >> 16 * k | whole << 128 - 16 * k) & 255, *(first[(k + j) % 8] for j in (0, 1, 3))) for k in range(8)}


def test_anchored_lines_equal_all_pairs(spark):
    """Lines of every length under the keys of the queries: the links of all pairs that share a key, be there few lines or many."""
    pick = random.Random(18)
    vocabulary = [f"{'long' * pick.randint(0, 3)}w{k}" for k in range(300)]
    rows = [(900, ""), (901, "same words here"), (902, "Same, words -- HERE!\n\n--"), (903, "x" * 70_000)]
    for n in [*range(1, 26), 30, 37, 50, 80, 127, 128, 300]:
        base = [pick.choice(vocabulary) for _ in range(n)]
        rows += [(len(rows), " ".join(changed(pick, base, share, vocabulary))) for share in (0, 0.03, 0.05, 0.1, 0.2, 0.25)]
    places = {}
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            places.setdefault(tuple(re.findall(r"[^\W_]+", line.lower())), []).append((i, k))
    blank = set(places.pop((), []))
    first, hashes, keys = {w: min(p) for w, p in places.items()}, {w: simhash(w) for w in places}, {w: anchored_keys(w) for w in places}
    alike = [
        (a, b) for a, b in combinations(first, 2)
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-6 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6
    ]
    links = [(first[a], first[b]) for a, b in alike if keys[a] & keys[b] and (hashes[a] ^ hashes[b]).bit_count() <= 40]
    groups = smallest(first.values(), links)
    kept = {p for p, g in groups.items() if p == g} | blank
    want = {i: [k for k in range(text.count("\n") + 1) if (i, k) in kept] for i, text in rows}
    assert 60 < len(links) < len(alike)

    def got(rows):
        return {r.doc_id: r.kept for r in line_dedup.kept_lines(frame(spark, rows), keys=line_dedup.ANCHORED).collect()}

    assert got(rows) == want
    others = [(10_000 + k, " ".join(f"o{pick.randrange(10**9)}" for _ in range(12))) for k in range(20_000)]
    beside = got(rows + others)
    assert {i: beside[i] for i, _ in rows} == want


def test_no_pair_of_lines_is_left_out(spark, tmp_path):
    """The query's rows are those of all pairs by edits alone: also where no SimHash key is shared, all long words changed, or four words meet five."""
    pick = random.Random(21)
    vocabulary = [f"{'long' * pick.randint(0, 3)}w{k}" for k in range(300)]
    rows = [(900, ""), (901, "same words here"), (902, "Same, words -- HERE!\n\n--"), (903, "x" * 70_000), (904, None)]
    for n in [*range(1, 26), 30, 37, 50, 80, 128, 300]:
        for _ in range(3):
            base = [pick.choice(vocabulary) for _ in range(n)]
            rows += [(len(rows), " ".join(changed(pick, base, share, vocabulary))) for share in (0, 0.1, 0.15, 0.2, 0.2, 0.25)]
    for k in range(20):
        four = [f"n{k}{x}" for x in "abcd"]
        rows += [(2000 + 2 * k, " ".join(four)), (2001 + 2 * k, " ".join(changed(pick, four, 0, vocabulary)))]
    short = [f"s{k}" for k in range(40)]
    for k in range(6):  # ten of fifty words are long, and all of these change
        rows.append((3000 + k, " ".join(w for j in range(10) for w in (*short[4 * j : 4 * j + 4], f"longword{k}{j}"))))
    places = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            places.setdefault(tuple(re.findall(r"[^\W_]+", line.lower())), []).append((i, k))
    blank = set(places.pop((), []))
    first = {w: min(p) for w, p in places.items()}
    links = [
        (first[a], first[b]) for a, b in combinations(first, 2)
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-6 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6
    ]
    groups = smallest(first.values(), links)
    kept = {p for p, g in groups.items() if p == g} | blank
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.kept_lines) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    own = {i: [k for k in range(text.count("\n") + 1) if (i, k) in kept] for i, text in rows if text is not None}
    assert got == {i: (text.count("\n") + 1, len(own[i]), ",".join(map(str, own[i]))) for i, text in rows if text is not None}
    assert not any(own[3001 + k] for k in range(5))


def test_what_meets_hangs_on_two_lines_alone(spark):
    """Pairs that are linked among few lines are linked beside many others."""
    assert line_dedup.block_width(10) == line_dedup.block_width(10**9)
    pick = random.Random(19)
    vocabulary = [f"word{k}" for k in range(5000)]
    rows = []
    for k in range(400):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([20, 40, 60, 100]))]
        copy = list(base)
        for at in range(10, len(base), 20):
            copy[at] = pick.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    others = [(10_000 + k, " ".join(f"other{pick.randrange(10**9)}" for _ in range(12))) for k in range(20_000)]
    few, many = (
        {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, r)).collect() if r.doc_id < 10_000} for r in (rows, rows + others)
    )
    assert few == many and sum(not t for t in few.values()) >= 0.9 * 400


def test_many_variants_of_one_line(spark):
    """A group far above any bound of candidates, and blocks that many lines share."""
    pick = random.Random(10)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(1500):
        words = list(base)
        words[pick.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.kept for r in line_dedup.kept_lines(frame(spark, rows)).collect()}
    assert sum(map(len, got.values())) <= 30 and got[0] == [0]


def test_very_long_lines_are_matched(spark):
    """One edit in a line of 70,000 words, more than the lanes of the sums once held."""
    words = [f"w{k}" for k in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:35_000], "other", *words[35_000:]])), (3, "short line of some other words")]
    got = {r.doc_id: r.kept for r in line_dedup.kept_lines(frame(spark, rows)).collect()}
    assert got == {1: [0], 2: [], 3: [0]}


def test_methods_of_votes_are_small_enough_to_be_compiled(spark, monkeypatch):
    """The JVM only interprets methods of more than 8,000 bytes."""
    sizes = []

    def note(df):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain("codegen")
        sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())))
        return df

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df: write(note(df)))
    try:
        note(line_dedup.lines(frame(spark, [(1, "one two three four five")])))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 0 < max(sizes) < 8000


def test_votes_are_added_four_words_at_a_time(spark, monkeypatch):
    """Hashes of lines of many lengths by their definition; the list of long words is made once, and a row holds four words."""
    sizes = [1, 2, 3, 4, 5, 7, 8, 123, 124, 125, 126, 127, 128, 247, 248, 249, 380]
    texts = [[f"word{chr(97 + n % 26)}{k}" for k in range(n)] for n in sizes]
    words = spark.createDataFrame([(k, w) for k, t in enumerate(texts) for w in t], "line INT, word STRING")
    hashed = words.selectExpr("line", "xxhash64(word) as a", "xxhash64(xxhash64(word)) as b").collect()

    def majority(hashes):
        bits = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))
        return bits - (bits >> 63 << 64)

    want = {}
    for k, n in enumerate(sizes):
        a, b = [r.a for r in hashed if r.line == k], [r.b for r in hashed if r.line == k]
        want[k] = (n, majority(a), majority(b), min(a) >> 32)
    plans = []
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    got = line_dedup.lines(frame(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert {r.doc_id: (r.n, r.sim_a, r.sim_b, r.first_0) for r in got} == want
    assert plans[0].count("filter(") == 1 and "explode(sequence(0" in plans[0]
