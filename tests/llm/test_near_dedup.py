"""Near-duplicate groups against brute force over full sets."""

import random
import re

from tessera.llm import near_dedup
from tessera.llm.components import components
from tessera.llm.near_dedup import near_duplicates, rarest
from tessera.llm.skew import heavy_keys, skew_join

DOC = "doc_id long, text string"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs, percent=85):
    sets, up = [(d, shingles(t)) for d, t in docs], {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(d), top(e)))
                up[y] = x
    return sorted((d, len(s), top(d), top(d) == d) for d, s in sets)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(120)]
    docs = [None, "", " \n", "One two", "one TWO", "x"]
    docs += [" ".join([word() for _ in range(rnd.randrange(3, 60))] + passage) for _ in range(60)]
    for changes in [0, 0, 1, 1, 2, 2, 3, 4, 5] * 12:
        copy = list(base)
        for _ in range(changes):
            copy[rnd.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    docs.append(" ".join(word() for _ in range(3000)))
    docs.append(docs[-1] + " more")
    rnd.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_groups_equal_brute_force(spark):
    docs = corpus(1)
    assert rows(near_duplicates(spark.createDataFrame(docs, DOC))) == brute(docs)


def test_large_buckets_take_the_exact_way(spark):
    docs = corpus(2)
    assert rows(near_duplicates(spark.createDataFrame(docs, DOC), pair_up_to=2)) == brute(docs)


def test_prefixes_follow_one_order(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g i")], DOC)
    members = spark.createDataFrame([(1, 4), (2, 4)], "rep long, n long")
    got = rarest(members, docs, 5, 50).collect()
    assert {(r["rep"], r["size"], r["place"]) for r in got} == {(d, 4, p) for d in (1, 2) for p in (1, 2, 3)}


def test_empty_table_extra_columns_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    wide = spark.createDataFrame([(5, "a b c d e f", 1, "k"), (5, "a b c d e f", 2, "k"), (2, "a b c d e f", 3, "k")], DOC + ", n long, key string")
    assert rows(near_duplicates(wide)) == [(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}}


def test_rows_without_an_id_are_kept(spark):
    docs = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (1, "a b c d e f"), (2, "")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(docs, DOC)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, None, True), (None, 0, None, True), (3, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True)], key=repr)


def test_heavy_keys_are_dealt_and_no_row_is_lost(spark):
    left = spark.createDataFrame([(7 if i % 3 == 0 else i, i) for i in range(600)] + [(None, 1)], "k long, x long")
    right = spark.createDataFrame([(k, str(k)) for k in range(0, 600, 2)] + [(7, "7"), (7, "again")], "k long, y string")
    (heavy,) = heavy_keys(left, ["k"]).collect()
    assert heavy["k"] == 7 and heavy["_shares"] >= 3
    for how in ("inner", "left"):
        got, want = skew_join(left, right, ["k"], how), left.join(right, "k", how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_many_copies_and_a_hub(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    docs = [(i, " ".join(base)) for i in range(50, 250)]
    for i in range(300, 420):
        copy = list(base)
        copy[rnd.randrange(200)] = "changed"
        docs.append((i, " ".join(copy)))
    assert rows(near_duplicates(spark.createDataFrame(docs, DOC))) == brute(docs)


def test_links_at_the_threshold_are_found(spark):
    """Pairs of 200-shingle sets with exactly 85 % and more in common; at 85 % one in ten thousand may be missed."""
    rnd, docs, pair = random.Random(6), [], 0
    for percent in (85, 87, 90):
        for _ in range(100):
            # a text of u words and its copy without the last ones: n of u shingles in common
            words = [f"x{rnd.randrange(10**9)}" for _ in range(204)]
            docs += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[: 2 * percent + 4]))]
            pair += 1
    got = rows(near_duplicates(spark.createDataFrame(docs, DOC)))
    assert sum(not r[3] for r in got) >= pair - 1 and len(got) == 2 * pair


def test_members_of_a_large_group_do_not_all_meet(spark, monkeypatch):
    """Near copies of a text and as many looser ones, all in the same buckets: the join by rare shingles matches fewer rows than there are pairs."""
    rnd, met = random.Random(11), []
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    docs = []
    for changes in [1, 2, 3, 6, 7, 8] * 40:
        copy = list(base)
        for at in rnd.sample(range(120), changes):
            copy[at] = f"w{rnd.randrange(10**6)}"
        docs.append((len(docs), " ".join(copy)))

    def watched(left, right, on, *how, **more):
        if on[0] == "shingle" and "y" in right.columns:
            met.append(left.select(on).join(right.select(on), on).count())
        return skew_join(left, right, on, *how, **more)

    monkeypatch.setattr(near_dedup, "skew_join", watched)
    assert rows(near_duplicates(spark.createDataFrame(docs, DOC), pair_up_to=8)) == brute(docs)
    assert len(met) == 1 and met[0] < len(docs) * (len(docs) - 1) // 2


def test_differences_of_linked_sets_have_enough_in_common():
    rnd, some = random.Random(12), 0
    for percent in (50, 80, 85):
        for _ in range(300):
            hub = set(range(rnd.randrange(0, 40)))
            one = set(rnd.sample(range(60), rnd.randrange(1, 50))) if rnd.random() < 0.3 else hub ^ set(rnd.sample(range(60), rnd.randrange(20)))
            other = one ^ set(rnd.sample(range(60), rnd.randrange(12)))
            linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
            near = [linked(x, hub) for x in (one, other)]
            if not linked(one, other) or all(near):
                continue
            some += 1
            for x, alone in ((one, not near[1]), (other, not near[0])):
                assert near_dedup.least_common(len(x ^ hub), len(x), len(hub), alone, percent) <= len((one ^ hub) & (other ^ hub))
    assert some > 100
