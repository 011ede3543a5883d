"""Each operator against a brute-force version, a library, or a round trip, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from breadthline.llm import (
    common,
    components,
    decontaminate,
    fingerprint,
    jaccard,
    language,
    packing,
    pretokens,
    quality,
    secrets,
    sharding,
    tokens,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = ("The river ran past the old mill and turned north. Nobody in the village could say when "
        "the wheel had stopped. Children came there to fish in summer evenings. ")
OTHER = ("Der Fluss lief an der alten Mühle vorbei und bog nach Norden ab. Niemand im Dorf konnte "
         "sagen, wann das Rad stehen geblieben war. Im Sommer kamen Kinder zum Angeln. ")


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, very long, repeated and tied rows."""
    return [
        (1, GOOD, "en", "a", 1), (1, GOOD, "en", "a", 1), (2, GOOD, "en", "b", None),
        (3, "", "en", None, 0), (4, None, None, "a", None), (None, OTHER, "de", "b", 3),
        (5, " \n\t ", "de", "a", 4), (6, OTHER * 900, "de", "a", 5), (7, "12345 !!", "en", "a", 6),
        (8, OTHER, None, None, None), (9, "日本語 text 😀 <|endoftext|> x", "en", "c", 7),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    return rows.selectExpr("*", "1 as score", "'x' as predicted", "2 as part", "'y' as place")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 2), int(i % 3 == 0)) for i in range(1, 9)] + [(None, 1, 1), (2, None, None)],
        "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- tokens ---------------------------------------------------------------------------------------

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "\t", "'s", "'ll", "é", "1", "½", "!", "**", "日本",
         "<|endoftext|>", "　", "\xa0", "😀", "é", "\r\n", "\x1c", "\x85", "​",
         "x" * 30, "aaaa", "ab" * 9, "THE ", " the", "\x00", "ⅷ", "_", " ", " "]


def random_texts(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(pretokens.default_path())


def test_counts_are_the_librarys():
    texts = random_texts(3000, 1)
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert tokens.count(texts, pretokens.default_path()) == want


def test_ids_are_the_librarys():
    texts = random_texts(1500, 2)
    want = [[*e.ids, 0] for e in library().encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(d, "<u4").tolist() for d in packing.encode(texts, pretokens.default_path())]
    assert got == want


def test_any_gap_between_words_is_read_as_the_library_does():
    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b"
    texts = [t for g in blanks for t in (g, f"{g}a", f"a{g}", f"a{g}b", f"a{g}{g}b, c", f"a \n{g}b")]
    texts += ["", "a b\nÉtÉ, c.\n-- d's 5x ;.", "x<|endoftext|>\ny, <|endoftext|>", "<|endoftext|>",
              "ªº µ, ﬁ. İ; ß!? a,b a.5 5, ,", "w" * 5000 + ", w"]
    want = [[*e.ids, 0] for e in library().encode_batch(texts, add_special_tokens=False)]
    for some in (slice(None), slice(0, 7), slice(7, None)):
        got = packing.encode(texts[some], pretokens.default_path())
        assert [np.frombuffer(d, "<u4").tolist() for d in got] == want[some]


def test_a_word_is_merged_once_whatever_signs_follow(monkeypatch):
    merged, merge_all = [], pretokens.merge_all
    monkeypatch.setattr(packing, "_KEPT", {})
    monkeypatch.setattr(pretokens, "merge_all", lambda vocab, some: (
        merged.extend(some), merge_all(vocab, some))[1])
    for text in ("one quorvex", "one quorvex, quorvex; one", "one quorvex. one quorvex!"):
        packing.encode([text], pretokens.default_path())
    assert merged.count(b" quorvex") == 1


def test_token_rows(odd, empty):
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
             for r in tokens.token_counts(odd).collect()}
    assert (3, 0, 0, False) in found and (4, 0, 0, False) in found
    assert any(r[0] == 6 and r[3] for r in found)
    assert tokens.token_counts(odd).count() == 11 and tokens.token_counts(empty).count() == 0


# --- packing --------------------------------------------------------------------------------------

def test_layouts_fill_without_gaps():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([5, 10, 30])
        histogram = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(8)}
        layouts = packing.match(histogram, capacity)
        used: dict[int, list] = {}
        for length, count in histogram.items():
            for s, o in zip(*(x.tolist() for x in layouts.place(
                    np.full(count, length), np.arange(count)))):
                used.setdefault(s, []).append((o, length))
        assert len(used) == layouts.sequences
        for pieces in used.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= capacity


def test_packing_is_close_to_the_bound():
    rng = random.Random(4)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        length = min(2048, int(rng.lognormvariate(6.6, 1)) + 1)
        histogram[length] = histogram.get(length, 0) + 1
    bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert packing.match(histogram, 2048).sequences <= 1.01 * bound


def test_pieces_put_documents_together_again(odd, empty):
    found = packing.pack(odd, 64).collect()
    ids = {t: [*library().encode(t or "", add_special_tokens=False).ids, 0]
           for _, t, *_ in odd_rows()}
    long = sorted((r for r in found if r.doc_id == 6), key=lambda r: r.piece)
    whole = ids[OTHER * 900]
    assert [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1]]
    assert sum(r.length for r in long) == len(whole)
    assert all(r.length == 64 for r in long[1:])
    for r in long:
        part = np.array(whole[r.start:r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 64
    assert len({(r.doc_id, r.piece) for r in found if r.doc_id == 1}) < sum(
        r.doc_id == 1 for r in found)
    assert packing.pack(empty).count() == 0


# --- shards ---------------------------------------------------------------------------------------

def test_shards_match_the_mixture(spark, odd, empty):
    docs = spark.range(2000).selectExpr(
        "id as doc_id", "concat('t', id % 7) as text",
        "case when id % 3 = 0 then 'hot' else concat('s', id % 10) end as source")
    found = sharding.shards(docs, 40)
    rows = found.collect()
    assert sorted(np.bincount([r.shard for r in rows])) == [50] * 40
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(50))
    hot = [r.rows for r in sharding.mixture(found, docs).where("source = 'hot'").collect()]
    assert len(hot) == 40 and max(hot) - min(hot) <= 2
    few = sharding.shards(odd, 4).collect()
    assert sorted(np.bincount([r.shard for r in few])) == [2, 3, 3, 3]
    assert {r.size for r in few if r.doc_id in (3, 4)} == {16}
    assert sharding.shards(empty).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------

def test_fingerprints(odd, empty):
    found = rows_of(fingerprint.fingerprints(odd))
    assert len(found) == 11
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for row, after in zip(order, order[1:] + order[:1]):
        text, following = row[1] or "", after[1] or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     fingerprint.fingerprint(text), fingerprint.fingerprint(edited)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted((r[:5] for r in found), key=key) == sorted(want, key=key)
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in found)
    assert fingerprint.fingerprints(empty).count() == 0


def test_likeness_and_changes():
    lines = [f"Line {i} tells of river {i * i} and of nothing else." for i in range(40)]
    one = fingerprint.fingerprint("\n".join(lines))
    lines[20] = "This one is new."
    other = fingerprint.fingerprint("\n".join(lines))
    assert 0.9 < fingerprint.likeness(one, other) < 1
    assert len(fingerprint.changes(one, other)) == 1
    assert fingerprint.likeness(one, one) == 1 and fingerprint.changes(one, one) == []
    assert fingerprint.fingerprint("a\n\nb") != fingerprint.fingerprint("a\nb")
    assert fingerprint.likeness(fingerprint.fingerprint(""), one) == 0


# --- Jaccard join ---------------------------------------------------------------------------------

def word_sets(text: str) -> set:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    lowest: dict[int, int] = {}
    for i, row in enumerate(rows):
        lowest[root(i)] = min(row[0], lowest.get(root(i), row[0]))
    return sorted((row[0], lowest[root(i)], links[i]) for i, row in enumerate(rows))


def test_join_is_brute_force(spark, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 2, 3, 60])):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "One, two!"), (1004, "!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_join(docs)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect())
    assert got == brute(rows)
    kept = {r.doc_id for r in jaccard.keep_one_of_each(docs).collect()}
    assert kept == {class_id for _, class_id, _ in got}
    assert jaccard.jaccard_join(empty).count() == 0


def test_join_on_odd_rows(odd):
    found = sorted(rows_of(jaccard.jaccard_join(odd)), key=str)
    assert len(found) == 11
    assert [r for r in found if r[0] == 1] == [(1, 1, 1, 2)] * 2
    assert (2, 1, 1, 2) in found and (3, 3, 3, 0) in found and (4, 4, 4, 0) in found
    kept = jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3)) == [1, 3]


def test_copies_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame(
        [(5, a), (7, a), (5, b), (3, b), (None, c), (None, c.upper()), (None, c), (9, "!!"), (9, "!!"),
         (None, b), (2, None)], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(docs).collect()), key=str)
    assert [r for r in kept if r[1] in (a, b)] == [(3, b), (5, a)]
    assert len([r for r in kept if r[1] and r[1].lower() == c]) == 1
    assert kept.count((9, "!!")) == 2 and (2, None) in kept and len(kept) == 6


def near_copies(rng: random.Random, count: int, words: int = 300) -> list[str]:
    base = [f"w{rng.randrange(5_000)}" for _ in range(words)]
    texts = []
    for _ in range(count):
        some = list(base)
        for _ in range(rng.randint(0, 4)):
            some[rng.randrange(words)] = f"w{rng.randrange(5_000)}"
        texts.append(" ".join(some))
    return texts


def test_sieve_lets_its_own_rows_through(spark, empty):
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id * 3) as doc_id", "cast(id as string) as key")
    passes = common.sieve(rows, "doc_id", "key")
    assert rows.where(passes("doc_id", "key")).count() == 20_000
    others = spark.range(20_000).selectExpr("id * 3 + 1 as a", "cast(id as string) as b")
    assert others.where(passes("a", "b")).count() < 1_000
    assert spark.range(500).where(common.sieve(empty, "doc_id")("id")).count() == 0


def test_differences_give_the_set_back():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        head, runs = (np.sort(rng.choice(pool, rng.integers(1, 50), replace=False)) for _ in range(2))
        back = jaccard.restored(head, jaccard.difference(head, runs))
        assert np.array_equal(np.sort(back), runs)


def test_blocks_of_a_large_group_get_differences(spark, monkeypatch):
    texts = near_copies(random.Random(8), 200) + near_copies(random.Random(9), 3)
    # One member of the large group has all of its runs and three times as many of its own.
    rows = list(enumerate([*texts, texts[0] + "".join(f" x{i}" for i in range(60))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, compare = [], jaccard._compare

    def seen(pairs, threshold):
        sent.append(pairs.selectExpr("sum(length(set))").first()[0])
        return compare(pairs, threshold)

    monkeypatch.setattr(jaccard, "_compare", seen)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect())
    assert got == brute(rows)
    whole = sum(s.nbytes for s in jaccard.run_sets([text for _, text in rows]))
    assert sent[0] < whole / 2  # whole sets went to each of four blocks before


def moved_columns(frame) -> list[tuple[set[str], str]]:
    """Columns that each exchange of the plan moves, with the plan below it."""
    found, nodes = [], [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        below, out = node.children(), node.output()
        nodes += [below.apply(i) for i in range(below.size())]
        if node.nodeName() == "Exchange":
            found.append(({out.apply(i).name() for i in range(out.size())}, node.toString()))
    return found


def test_texts_without_a_copy_do_not_move(spark, monkeypatch):
    texts = near_copies(random.Random(8), 4) + [GOOD, GOOD.upper()] + [f"{i} " * 9 for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    landed, land = [], jaccard.land

    def seen(frame, name):
        landed.extend(moved_columns(frame))
        return land(frame, name)

    monkeypatch.setattr(jaccard, "land", seen)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        kept = jaccard.keep_one_of_each(docs)
        assert landed and not any("text" in columns for columns, _ in landed)
        moved = [below for columns, below in moved_columns(kept) if "text" in columns]
        assert moved and all("subquery" in below.lower() for below in moved)
        assert sorted(r.doc_id for r in kept.collect()) == [0, 4, *range(6, 15)]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert 200 not in got


def test_runs_needed_grow_with_depth_and_recall():
    assert jaccard.runs_needed(0.8, 1, 0.99) < jaccard.runs_needed(0.8, 5, 0.99)
    assert jaccard.runs_needed(0.8, 3, 0.9) < jaccard.runs_needed(0.8, 3, 0.999)


def test_roots_draw_what_the_recall_needs():
    runs = jaccard.runs_needed(0.8, 5, 0.99)
    drawn = jaccard._mix(jaccard._roots(runs)[:, None] + jaccard.NUMBERS) < jaccard._share(0.8)
    together = 1.0
    for _ in range(4):
        together = 1 - np.exp(-together)
    assert (1 - 0.8 * together) ** drawn.sum() <= 0.01
    assert drawn.sum() >= jaccard.coordinates_needed(0.8, 5, 0.99)


# --- decontamination ------------------------------------------------------------------------------

def edit_distance_anywhere(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


def test_edit_search_is_the_plain_table():
    rng = random.Random(6)
    for _ in range(300):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        assert decontaminate.edit_search(pattern, text)[0] == edit_distance_anywhere(pattern, text)


def test_contamination(spark, odd, empty):
    item = ("Which of these rivers runs north? It turned past the mill, said the miller, and nobody "
            "asked him again until the winter came. Then the answer was plain to all of them.")
    words = item.split(" ")
    near = " ".join(words[:10] + ["certainly"] + words[11:])
    docs = spark.createDataFrame([
        (1, GOOD + item + " " + GOOD), (2, GOOD + near + " " + GOOD), (3, GOOD * 4),
        (4, OTHER + item.upper().replace(" ", "!! ")), (5, None), (6, "see item seven here"),
        (7, item[:60])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "item seven")],
                                      "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (6, 4)}
    row = got[1, 1]
    assert (GOOD + item)[row.start:row.stop] == item.rstrip(".") and row.distance == 0
    assert got[2, 1].distance > 0
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, benchmark).collect()} == {
        3, 5, 7}
    assert decontaminate.contamination(odd, benchmark).count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).count() == 0
    split = decontaminate.contamination(docs, benchmark, block=1)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == set(got)


def test_passages_without_anchors_are_found():
    item = ("Which of these rivers runs north? It turned past the mill, said the miller, and nobody "
            "asked him again until the winter came. Then the answer was plain to all of them.")
    chinese = "河流经过老磨坊然后向北流去村里没有人能说出水车什么时候停下来的夏天的晚上孩子们来这里钓鱼老人坐在树下讲过去的故事大家都听得很认真"
    short = "the wheel stopped turning in may"
    items_texts = [item, item[34:].lower(), chinese, short]
    plain = re.sub(r"[^\w ]", "", item.lower())
    texts = [f"they said that {plain} and went on", f"they said {item[34:]}", GOOD * 3,
             f"以前{chinese[:30]}那{chinese[31:]}以后", "he knew the wheel stoped turning in may or so"]
    walks = decontaminate.Walks(decontaminate.runs_needed(items_texts, 0.2, 0.95, 48))
    items = decontaminate.Items.of([0, 1, 2, 3], items_texts, walks, 48)
    found = {(t, i): rest for t, i, *rest in decontaminate.search(texts, items, walks, 0.2)}
    assert {(0, 0), (0, 1), (1, 1), (3, 2), (4, 3)} <= set(found) and (2, 0) not in found
    assert found[0, 0][2] == 0 and found[3, 2][2] == 1 and found[4, 3][2] == 1
    assert texts[4][found[4, 3][0]:found[4, 3][1]] == "the wheel stoped turning in may"


def test_recall_at_the_distance_allowed():
    rng, choice = np.random.default_rng(9), random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ra", "mo", "li", "stu") for b in "bdkp" for c in ("en", "is", "o")]
    items_texts = [" ".join(choice.choices(words, k=40)) for _ in range(120)]
    runs = decontaminate.runs_needed(items_texts, 0.2, 0.95, 48)
    walks = decontaminate.Walks(runs)
    items = decontaminate.Items.of(list(range(120)), items_texts, walks, 48)
    copies = [f"so {decontaminate.edited(t, 0.18, rng)} it was" for t in items_texts]
    found = {(t, i) for t, i, *_ in decontaminate.search(copies, items, walks, 0.2)}
    assert sum((i, i) in found for i in range(120)) >= 0.9 * 120
    assert runs <= decontaminate.runs_needed(items_texts, 0.2, 0.99, 48)


# --- classifiers and languages --------------------------------------------------------------------

def test_quality_network_learns():
    rng = random.Random(7)
    good = [GOOD * rng.randint(1, 4) + str(i) for i in range(60)]
    bad = [" | ".join(rng.choices(GOOD.split(), k=60)) for _ in range(60)]
    texts, marks = good + bad, np.array([1] * 60 + [0] * 60)
    net = quality.fit(texts[::2], marks[::2], steps=120)
    score = quality.score(net, texts[1::2])
    assert ((score > 0.5) == marks[1::2]).mean() > 0.95
    alone = np.concatenate([quality.score(net, [t]) for t in texts[1::2]])
    assert np.allclose(alone, score, atol=1e-6)


def test_gradients_are_differences():
    net = quality.Network.fresh(3)
    for name in quality.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts, marks = [GOOD, "a | b | c", OTHER * 4], np.array([1.0, 0.0, 1.0])
    grads = quality._gradients(net, texts, marks, np.ones(3))

    def loss() -> float:
        p = quality.score(net, texts)
        return float(-(marks * np.log(p) + (1 - marks) * np.log(1 - p)).mean())

    for name, place in (("mix", (3, 2)), ("out", (1,)), ("filters", (5, 40)), ("embed", (101, 2))):
        values, step = getattr(net, name), 1e-3
        old = values[place]
        values[place] = old + step
        up = loss()
        values[place] = old - step
        down = loss()
        values[place] = old
        assert abs((up - down) / (2 * step) - grads[quality.NAMES.index(name)][place]) < 2e-3


def test_toxicity_learns():
    rng = random.Random(8)
    plain = [" ".join(rng.choices(GOOD.lower().split(), k=90)) for _ in range(160)]
    marks = np.arange(160) % 2
    texts = [t + " grubbleskort you wretched snivelard " * 2 if m else t
             for t, m in zip(plain, marks)]
    model = toxicity.fit(texts[:120], marks[:120])
    assert ((model.score(texts[120:]) > 0.5) == marks[120:]).mean() > 0.95
    assert toxicity.fit(texts[:4], np.zeros(4)).score(texts[:2]).max() < 1e-9


def test_classifiers_on_odd_rows(odd, empty, labels):
    for made in (quality.quality(odd, labels), toxicity.toxicity(odd, labels)):
        rows = made.collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id == 3} == {zlib.crc32(b"3") % 5 == 0}
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.quality(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("score > 0.01").count() == 0


def test_language(spark, odd, empty):
    docs = spark.createDataFrame(
        [(i, (GOOD if i % 2 else OTHER)[i % 40:], "en" if i % 2 else "de") for i in range(80)]
        + [(100, None, "en"), (101, "12 ... !", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language.language(docs).collect()}
    assert all(rows[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert {(rows[i].lang_pred, rows[i].score) for i in (100, 101)} == {("und", 0.0)}
    assert rows[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(80))
    assert language.language(odd).count() == 11 and language.language(empty).count() == 0
    assert language.keep_identified(odd).columns == odd.columns


# --- secrets --------------------------------------------------------------------------------------

def test_secrets(spark, odd, empty):
    key = hashlib.sha1(b"k").hexdigest()
    docs = spark.createDataFrame(
        [(i, GOOD + str(i)) for i in range(60)]
        + [(100, f'Here token = "{key}" stands twice: token = "{key}" .'),
           (101, "Here token = \"river_mill_village_wheel\" is named."),
           (102, f"See commit {key} of last week."), (103, "Card 4556737586899855 and more.")],
        "doc_id long, text string")
    found = secrets.secrets(docs).collect()
    assert [r.is_secret for r in found if r.doc_id == 100] == [True, True]
    assert not any(r.is_secret for r in found if r.doc_id != 100)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[100] == 'Here token = "[SECRET]" stands twice: token = "[SECRET]" .'
    assert clean[102].count(key) == 1 and len(clean) == 64
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 11
    assert secrets.secrets(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_every_shape_of_a_secret_is_hidden(spark):
    def made(i, length):
        return "".join(random.Random(i).choices("ABCDEFGHJKLMabcdefghjkmnpqrstuvwxyz0123456789", k=length))

    padded = "dGhpcyBpcyBhIDI0Ynl0ZSBrZXkgMTIzNDU2Nzg5MDEyMzQ1Ng=="
    jwt = f"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.{made(1, 43)}"
    shapes = [
        (f'token = "{padded}"', padded), (f'api_key="{padded}"', padded),
        (f'{{"user":"bob","api_key":"{made(2, 32)}"}}', made(2, 32)),
        (f'{{"private_key":"{made(3, 32)}","user":"bob"}}', made(3, 32)),
        (f"https://host.example/v1?token={made(4, 32)}&page=2", made(4, 32)),
        (f"user=bob;password={made(5, 16)};", made(5, 16)),
        (f"secret: `{made(6, 32)}`", made(6, 32)), (f"token = `{made(7, 32)}`", made(7, 32)),
        (f"Authorization: Bearer {jwt} .", jwt), (f'token = "{jwt}"', jwt)]
    docs = spark.createDataFrame(
        [(i, GOOD + str(i)) for i in range(60)]
        + [(100 + i, f"Here is {text} of last week.") for i, (text, _) in enumerate(shapes)],
        "doc_id long, text string")
    found = {(r.doc_id, r.candidate) for r in secrets.candidates(docs).collect()}
    assert {(100 + i, key) for i, (_, key) in enumerate(shapes)} <= found
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, (text, key) in enumerate(shapes):
        assert clean[100 + i] == f"Here is {text.replace(key, '[SECRET]')} of last week."
    assert all(clean[i] == GOOD + str(i) for i in range(60))


def test_examples_come_from_the_lowest_hashes_and_move_no_other_text(spark, tmp_path):
    rows = [(i % 400, f"{'one two three ' * 20}{i}") for i in range(1200)] + [(None, "x"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted((r.h, r.doc_id) for r in docs.selectExpr("xxhash64(doc_id) h", "doc_id").where(
        "doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    ).dropDuplicates().collect())
    lowest = {i for _, i in order[:10]}
    near = secrets.lowest_hashes(docs, 30)
    assert {r.doc_id for r in near.collect()} == lowest and near.count() <= 31
    assert secrets.lowest_hashes(docs, 31).select("doc_id").distinct().count() == 11
    assert secrets.lowest_hashes(docs.limit(0), 5).count() == 0
    assert secrets.examples(docs, 30).count() == 30 * 26


def test_secret_scan_is_native(spark, odd):
    plan = secrets.secrets(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline -------------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    key = hashlib.sha1(b"z").hexdigest()
    item = " ".join(f"Question word{i} of the test item" for i in range(6))
    texts = [GOOD + " ".join(f"en{i * j}" for j in range(40)) for i in range(1, 30)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[3], "en", "a", 1), (51, GOOD + item, "en", "b", 1), (52, None, "en", "b", 0),
             (53, "123", "en", "b", 3), (54, f'{OTHER} token = "{key}"', "de", "b", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {*range(29), 54}
    hidden = f'{OTHER} token = "[SECRET]"'
    ids = [*library().encode(hidden, add_special_tokens=False).ids, 0]
    assert [r.ids_crc32 for r in found if r.doc_id == 54] == [
        zlib.crc32(np.array(ids, "<u4").tobytes())]


def test_only_one_piece_of_a_batch_is_python_strings():
    import tracemalloc

    import pyarrow as pa

    texts = ["x" * 500_000] * 40 + [None, "é日😀"]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(42), "text": texts})
    whole = [text or "" for text in texts]
    sizes, seen = [], []
    tracemalloc.start()
    for part, found in common.pieces(batch):
        sizes.append(part.num_rows)
        seen += [part.column("doc_id").to_pylist(), [len(t) for t in found]]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [3] * 14
    assert sum(seen[1::2], []) == [len(t) for t in whole] and sum(seen[::2], []) == [*range(42)]
    assert most < 8_000_000


def test_memory_goes_back_when_a_task_has_freed_it(monkeypatch):
    import weakref

    held, gone = [], []

    def run(batches):
        kept = np.zeros(10)
        held.append(weakref.ref(kept))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: gone.append(held[0]() is None))
    assert list(common.freeing(run)(iter([1, 2]))) == [1, 2]
    assert gone == [True]


def test_stages_get_their_rows_in_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 4_000, 1, 1).selectExpr("id as doc_id", "repeat('x', 10000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    try:
        for number in (0, 1, 2, 4):
            spark.conf.set(name, before)
            empty = spark.createDataFrame([], SCHEMA)
            stage = corpus_pipeline.STAGES[number][1]
            calls = {0: "keep_identified", 1: "keep_one_of_each", 2: "remove_contaminated", 4: "pack"}
            module = {0: language, 1: jaccard, 2: decontaminate, 4: packing}[number]
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(module, calls[number], lambda *a: empty)
                patch.setattr(corpus_pipeline, "table", lambda *a: None)
                stage(spark, empty, "")
            found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
            assert sum(found) >= 40_000_000 and max(found) < 9_000_000
    finally:
        spark.conf.set(name, before)
