"""Token files, the Merkle manifest and tokenizer alignment against plain versions of each."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from breadthline.llm import alignment, manifest, token_files
from breadthline.llm.eliasfano import EliasFano
from breadthline.llm.pretokens import byte_alphabet
from tests.llm.test_llm import SCHEMA, odd_rows, random_texts

CLASHING = ["'u' as tree", "1 as idx", "2 as size", "'d' as digest", "'x' as part", "3 as row",
            "4 as block", "5 as pair", "6 as at", "'p' as proof", "7 as start", "8 as sum"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", *CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Elias-Fano ---------------------------------------------------------------------------------

@pytest.mark.parametrize("numbers", [
    [], [0], [7], [0, 0, 0], [2**64 - 1], [0, 2**64 - 1], list(range(2000)),
    [5] * 1500 + [10**12] * 700, sorted(random.Random(1).choices(range(10**6), k=4000)),
    sorted(np.random.default_rng(2).integers(0, 2**63 - 1, 1537).tolist()),
])
def test_elias_fano_gives_the_numbers_back(numbers):
    found = EliasFano.from_bytes(EliasFano.of(np.array(numbers, dtype=np.uint64)).to_bytes())
    assert found.slice(0, len(numbers)).tolist() == numbers
    for i in {0, 1, 511, 512, 513, len(numbers) // 2, len(numbers) - 1} & set(range(len(numbers))):
        assert found.select(i) == numbers[i]
        assert found.rank(numbers[i]) == sum(n < numbers[i] for n in numbers)
        assert found.slice(i, i + 700).tolist() == numbers[i:i + 700]
    with pytest.raises(IndexError):
        found.select(len(numbers))


def test_elias_fano_is_small():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 1000, 100_000))
    bits = 8 * len(EliasFano.of(ends).to_bytes()) / len(ends)
    assert bits < 2 + np.log2(ends[-1] / len(ends)) + 0.5 < 64 / 5


# --- token files ----------------------------------------------------------------------------------

def library_ids(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_files.default_path())
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 1] for e in found]


SPECIAL = ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "don't DON'T it's 'S '", "J̌ Å x İi ẞß ſt",
           "Ⅷ ½²ª ﬁ", "x" * 5000, "ÀÖØ×÷ÿ Ÿ", "  \n\n a \t b\r\n", "1234 a1b2c3", "é ́e", ""]


def test_encoder_is_the_library():
    texts = random_texts(4000, 7) + SPECIAL
    encoder = token_files.Encoder(token_files.default_path(), 1, limit=500)
    for some in (texts[:1500], texts[1500:], texts):
        ids, lengths = encoder.encode(pa.array(some))
        ends = np.cumsum(lengths)
        got = [ids[b - n:b].tolist() for b, n in zip(ends, lengths)]
        assert got == library_ids(some)


def test_words_are_looked_up_without_their_signs(monkeypatch):
    asked, stretches = [], token_files.Encoder.stretches
    monkeypatch.setattr(token_files.Encoder, "stretches", lambda self, words: (
        asked.extend(words), stretches(self, words))[1])
    encoder = token_files.Encoder(token_files.default_path(), 1)
    texts = ["The river, Öl; don't", "THE river. öl 5 <x>!"]
    ids, lengths = encoder.encode(pa.array(texts))
    assert [ids[:lengths[0]].tolist(), ids[lengths[0]:].tolist()] == library_ids(texts)
    assert set(asked) == {"don't", "5", "<x>!"}


def plain_rows(rows):
    """(doc_id, start, n_tokens, crc32) by one walk in the order of (id, checksum of the text)."""
    start, found = 0, []
    for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows])):
        data = np.array(ids, dtype="<u4").tobytes()
        found.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return found


def test_files_hold_documents_in_order(spark, odd, empty):
    got = [tuple(r) for r in token_files.token_files(odd).collect()]
    assert len(got) == len(odd_rows())
    assert {(r[0], *r[2:]) for r in got} == {
        (r[0], *r[2:]) for r in plain_rows([(r[0], r[1]) for r in odd_rows()])}
    in_order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in in_order] == sorted([r[0] for r in got], key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in in_order] == [0, *np.cumsum([r[2] for r in in_order])[:-1].tolist()]
    assert token_files.token_files(empty).count() == 0


def test_many_small_files_and_reading_one_document(spark):
    rng = random.Random(4)
    ids = [rng.getrandbits(63) - 2**62 for _ in range(600)] + [2**63 - 1, -2**63]
    rows = sorted(zip(ids, random_texts(602, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write(docs, token_files.new_folder(spark), file_ids=400, batch_bytes=700)
    listed = sorted(files.collect())
    assert len(listed) > 8 and sum(f.n_docs for f in listed) == 602
    assert sorted(map(tuple, token_files.read(files).collect())) == plain_rows(rows)
    known = dict(zip([i for i, _ in rows], library_ids([t for _, t in rows])))
    for row in listed[:6]:
        file = token_files.TokenFile(row.path)
        position = 0
        for at, doc_id in enumerate(file.doc_ids(0, file.n_docs)):
            assert file.document(at).tolist() == known[doc_id]
            assert file.document_at(position) == file.document_at(
                position + len(known[doc_id]) - 1) == at
            position += len(known[doc_id])
        assert position == file.n_ids
        file.close()


def test_files_of_a_lost_attempt_are_never_read(spark):
    """A second attempt of every task leaves files that the table of files does not name."""
    docs = spark.createDataFrame(list(enumerate(random_texts(50, 3))), "doc_id long, text string")
    folder = token_files.new_folder(spark)
    lost = token_files.write(docs.limit(20), folder)
    files = token_files.write(docs, folder)
    assert lost.count() > 0 and token_files.read(files).count() == 50


# --- manifest -------------------------------------------------------------------------------------

def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row) -> str:
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    doc_id, text, lang, source, n_chars = row
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def plain_tree(digests: list[str], fanout: int):
    """Root, and for each leaf the siblings (left, right) level by level."""
    paths, members = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, groups = [], []
        for start in range(0, len(digests), fanout):
            run = digests[start:start + fanout]
            for slot in range(len(run)):
                for leaf in members[start + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            above.append(h(*run))
            groups.append([x for some in members[start:start + fanout] for x in some])
        digests, members = above, groups
    return digests[0], paths


def plain_manifest(rows, fanout: int = 2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in ordered:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]], fanout)
    root, upper = plain_tree([trees[g][0] for g in ordered], fanout)
    found = []
    for at, g in enumerate(ordered):
        for row, path in zip(groups[g], trees[g][1]):
            path = path + upper[at]
            doc_id, text, lang, source, n_chars = row
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            if tampered and n_chars is not None:
                n_chars += 1
            folded = plain_leaf((doc_id, text, lang, source, n_chars))
            for left, right in path:
                folded = h(left, folded, right)
            found.append((doc_id, plain_leaf(row), trees[g][0], root,
                          h(*[left + right for left, right in path]), folded, folded == root))
    return found


def many_rows():
    """Groups of 1, 2, 3, 8 and 37 rows, one of three quarters of all, null and odd names."""
    rng = random.Random(6)
    sizes = {"a": 1, "b": 2, None: 3, "B": 8, "é": 37, "": 5, "en": 190}
    ids = iter(rng.sample(range(-500, 5000), 400))
    return [(next(ids), rng.choice(["", None, "x" * n, "日本\n"]), lang, rng.choice(["s", None]),
             rng.choice([None, n])) for lang, size in sizes.items() for n in range(size)]


@pytest.mark.parametrize("rows", [many_rows(), odd_rows(), [(5, "t", "en", "s", 1)]])
def test_manifest_is_the_plain_tree(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASHING)
    got = [tuple(r) for r in manifest.manifest(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    if len(rows) > 100:
        assert {r[-1] for r in got} == {True, False}


def test_larger_runs_and_empty_tables(spark, empty):
    rows = many_rows()
    found, root = manifest.build(spark.createDataFrame(rows, SCHEMA), fanout=3)
    want = plain_manifest(rows, fanout=3)
    assert root == want[0][3]
    from pyspark.sql import functions as F
    folded = found.select(manifest.fold(F.col("leaf"), F.col("proof"))).distinct().collect()
    assert [r[0] for r in folded] == [root]
    assert {r["subroot"] for r in found.collect()} == {w[2] for w in want}
    assert manifest.manifest(empty).count() == 0 and manifest.build(empty)[1] is None


def test_any_change_is_found(spark):
    """A proof leads to the root for its own leaf only."""
    from pyspark.sql import functions as F
    rows, root = manifest.build(spark.createDataFrame(many_rows(), SCHEMA))
    other = F.sha2(F.col("leaf").cast("binary"), 256)
    hits = rows.select((manifest.fold(other, F.col("proof")) == root).alias("hit"))
    assert hits.filter("hit").isEmpty()


def test_manifest_runs_no_python(spark, odd):
    plan = manifest.manifest(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# --- alignment ------------------------------------------------------------------------------------

class Plain:
    """Both libraries on whole texts, groups by common ends, links by comparing all neighbours."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        a, b = alignment.default_paths()
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.back = {c: n for n, c in byte_alphabet().items()}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        first = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        second = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                  else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(first) != whole or b"".join(second) != whole:
            return None
        return [(a, first), (b, second)]

    def document(self, text):
        found = self.tokens(text) if text else None
        if found is None:
            return None
        spans = []
        for ids, parts in found:
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip(ids, [0, *ends], ends)))
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[i for i, s, e in side if low <= s and e <= high] for side in spans]
                  for low, high in zip([0, *common], common)] if len(common) < 300 else None
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        return len(spans[0]), len(spans[1]), len(common), links, groups


def plain_alignment(texts):
    plain = Plain()
    docs = [plain.document(t) for t in texts]
    counts = Counter(pair for d in docs if d for pair in set(d[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    found = []
    for d in docs:
        if d is None:
            found.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = d
        text = None if groups is None else ";".join(
            "|".join(",".join(map(str, side)) for side in group) for group in groups)
        found.append((n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links),
                      sum(counts[p] for p in links),
                      None if text is None else hashlib.sha256(text.encode()).hexdigest()))
    return found


UNUSUAL = ["▁x", "a ▁b c", "x▁ y", " ", "  ", "\n", "\n\n", " \n a", "a\n", "x" * 400, "foo \nbar",
           "a\t b", "a \x1c b", None, "", "<|endoftext|> </s> <s> <unk> <0x0A>", "é́ ́e",
           "The tokenization of antidisestablishmentarianism, naïvely.", "日本語 😀 тест"]


@pytest.mark.parametrize("chars", [300, 10**6])
def test_alignment_is_the_plain_one(spark, chars):
    texts = random_texts(400, 11) + UNUSUAL + UNUSUAL[-2:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "'x' as block", "1 as part", "2 as pairs").repartition(3)
    rows, pairs = alignment.align(docs, chars=chars)
    want = plain_alignment(texts)
    got = {r.doc_id: tuple(r)[1:] for r in rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ).collect()}
    assert len(got) == len(texts)
    for at, expected in enumerate(want):
        assert got[at][:6] == expected[:6], texts[at]
        if expected[6] is not None:
            assert got[at][6] == expected[6], texts[at]
    assert any(t and w[0] == 0 for t, w in zip(texts, want))
    plain = Plain()
    counts = Counter(p for d in map(plain.document, texts) if d for p in set(d[3]))
    assert {(r.a_id, r.b_id): r.docs for r in pairs.collect()} == counts


def test_alignment_of_odd_tables(spark, odd, empty):
    rows = alignment.alignment(odd).collect()
    assert len(rows) == len(odd_rows())
    blank = [r for r in rows if r.doc_id in (3, 4)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") or r.n_a == 0 for r in blank)
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_links >= long.n_groups > 10_000 and len(long.groups_sha256) == 64
    assert [r for r in rows if r.doc_id is None]
    assert alignment.alignment(empty).count() == 0


def test_stretches_of_a_bounded_memory_are_the_same():
    """Nothing depends on what a worker still holds."""
    texts = random_texts(300, 12)
    few = alignment.Sides(*alignment.default_paths(), limit=20, longest=3)
    many = alignment.Sides(*alignment.default_paths())
    for some in (texts[:150], texts[150:], texts):
        one, two = alignment.block_of(some, few), alignment.block_of(some, many)
        assert one.digests == two.digests and one.facts.tolist() == two.facts.tolist()
        assert one.pairs.tolist() == two.pairs.tolist() and one.held.tolist() == two.held.tolist()
