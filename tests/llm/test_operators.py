"""Each operator against a plain version of itself, and on rows that are odd."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from distillery.llm import chat, decontaminate, edits, neardup, neighbours, packing, pii, queries, secrets, store, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, spans string, n long, length long, text2 string"


def frame(spark, texts, ids=None):
    """Documents with other columns, some of whose names clash with those of results."""
    rows = [(k, t, "en", f"src{i % 2}", 9.0, "x", 1, 1, "y") for i, (k, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n", "a", "Hello, hello world. It's 10.0.0.1 <|endoftext|>", "x" * 5000, "É é ß 日本 👍🏽 word\x1cword", "Mail me@example.com or +1 (974) 555-3436 " * 50]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [*ODD, *ODD], [*range(len(ODD)), 3, 3, 4, 4, None, None, 5, 5])


def encoded(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def thue_morse(n, which):
    """Two words whose polynomial hashes are equal, whatever their base."""
    return "".join("ab"[(k.bit_count() + which) % 2] for k in range(n))


def test_words_encode_as_whole_texts(tokenizer):
    rng = random.Random(4)
    parts = ["word ", "a", "\n", ". ", "it's ", "É", "é", "İ", "ΑΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\xa0", "'S", "!?. ", "K", "日本", "12 3", "\x85", "👍🏽", "x" * 50, "Hello, ", "\x0b", "\x00", "é", "É"]
    parts += ["abcdefgh", "ijklmnop ", "q" * 17 + " ", "b\x00 ", "b ", "y" * 2000 + " "]
    small = tokens.WordEncoder(tokens.default_vocabulary(), table_words=50)
    for k in range(500):
        texts = [*("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(5)), thue_morse(2048, k % 2)]
        assert small.counts([t.encode() for t in texts]).tolist() == [len(encoded(tokenizer, t, 0)) - 1 for t in texts]
        for text, ids in zip(texts, small.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == encoded(tokenizer, text, 0)[:-1]


def test_words_with_marks_are_encoded_once(tokenizer):
    """A word that comes with many marks goes to the library once, and what it is encoded to is that of whole texts."""
    rng = random.Random(8)
    words = ["plain", "élan", "naïve", "straße", "Éclair", "x", "it's", "o'reilly", "ıX", "ab×cd", "e\u0301t", "<|endoftext|>", "a<|endoftext|>b", "c3p0", "日本語", "q" * 40]
    marks = ["", ".", ",", "!!", "***", "'", "'s", "'S.", "...'re", "=\u0338", "—.", "×", "÷!", "-", "_", "|>", "<", "(", "\u0301.", "\x1c"]
    small = tokens.WordEncoder(tokens.default_vocabulary(), table_words=200)
    for _ in range(300):
        texts = [" ".join(rng.choice(marks) + rng.choice(words) + rng.choice(marks) + rng.choice(["", rng.choice(words)]) for _ in range(12)) for _ in range(3)]
        for text, ids in zip(texts, small.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == encoded(tokenizer, text, 0)[:-1], text
    fresh = tokens.WordEncoder(tokens.default_vocabulary())
    names = ["".join(rng.choices("abcdefghé", k=6)) for _ in range(50)]
    fresh.encode([f"{w}{m}".encode() for w in names for m in (".", ",", "!", "***", "")])
    assert fresh.n_words <= len(names) + 4


def test_store_lists_chunks_of_many_recipes_at_once():
    """One batch of chunks for a batch of recipes, also where a recipe's lists were changed to differ in length."""
    kind = pa.list_(pa.binary()), pa.list_(pa.int32())
    same = [(7, [b"a", b"b", b"c"], [5, 3, 2]), (8, [], []), (9, [b"a"], [4])]
    for rows in (same, [*same, (10, [b"x", b"y"], [6]), (11, [b"z"], []), (12, [b"v"], [1, 2])]):
        uid, digests, lengths = zip(*rows, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(uid), pa.array(digests, kind[0]), pa.array(lengths, kind[1])], ["uid", "digests", "lengths"])
        out = list(store._listed(iter([batch])))
        assert len(out) == 1
        got = [tuple(r.values()) for r in out[0].to_pylist()]
        assert got[:4] == [(7, b"a", 5, 5), (7, b"b", 3, 2), (7, b"c", 2, 0), (9, b"a", 4, 0)]
        assert got[4:] == ([] if rows is same else [(10, b"x", 6, 6), (10, b"y", 6, 0), (11, b"z", 0, 0), (12, b"v", 1, 0)])


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_store(spark, odd, tokenizer, tmp_path, which):
    docs = odd if which == "odd" else odd.limit(0)
    root = str(tmp_path / which)
    store.write(docs, root)
    rows = sorted(store.read_digests(spark, root).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda x: x[:2])
    assert [r.doc_id for r in rows] == [k if known else None for known, k, _ in want]
    start = 0
    for r in rows:
        assert r.start == start and r.intact
        start += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(i), crc(i)) for i in (encoded(tokenizer, t, 2) for *_, t in want))
    if which == "odd":
        kept = spark.read.parquet(f"{root}/chunks").where("data is not null")
        assert kept.count() == kept.select("digest").distinct().count()
        ids = sorted(np.frombuffer(r.ids, "<u2").tolist() for r in store.read_documents(spark, root).collect())
        assert ids == sorted(encoded(tokenizer, t, 2) for *_, t in want)


@pytest.mark.parametrize("what", ["chunk", "reordered", "replaced", "missing", "segment", "manifest", "corpus"])
def test_store_sees_what_was_changed(spark, tmp_path, what):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=n)) for n in (3000, 2000, 4, 9, 1500)]
    root, changed = str(tmp_path / "s"), str(tmp_path / "t")
    store.write(frame(spark, texts), root)
    assert all(r.intact and r.store_intact for r in store.read_digests(spark, root).collect())
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in ("chunks", "recipes", "manifest")}
    digests, recipes = F.col("digests"), tables["recipes"]
    if what == "chunk":
        tables["chunks"] = tables["chunks"].withColumn("data", F.concat(F.expr("unhex('0000')"), F.expr("substring(data, 3)")))
    elif what == "reordered":
        tables["recipes"] = recipes.withColumn("digests", F.when(F.col("doc_id") == 0, F.reverse(digests)).otherwise(digests))
    elif what == "replaced":
        other = recipes.where("doc_id = 1").first()
        swap = F.col("doc_id") == 4
        value = {c: F.array(*map(F.lit, other[c])) for c in ("digests", "lengths")} | {"root": F.lit(bytes(other.root)), "n_tokens": F.lit(other.n_tokens)}
        tables["recipes"] = recipes.select(*[F.when(swap, value[c].cast(recipes.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in recipes.columns])
    elif what == "missing":
        tables["recipes"] = recipes.where("doc_id <> 3")
    elif what == "segment":
        tables["recipes"] = recipes.where(F.col("seg") != recipes.agg(F.max("seg")).first()[0])
    elif what == "manifest":
        tables["manifest"] = tables["manifest"].withColumn("root", F.when(F.col("level") == 0, F.expr("unhex('00')")).otherwise(F.col("root")))
    else:
        tables["manifest"] = tables["manifest"].where("level <> -1")
    for name, df in tables.items():
        df.write.parquet(f"{changed}/{name}")
    rows = {r.doc_id: r for r in store.read_digests(spark, changed).collect()}
    if what == "chunk":
        assert not any(r.intact for r in rows.values())
    else:
        assert not any(r.store_intact for r in rows.values())
        broken = {"reordered": {0}, "replaced": {4}}.get(what, set())
        assert not any(rows[k].intact for k in broken)
        if what == "manifest":
            assert not any(r.intact for r in rows.values())


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 49000, 20000).astype("<u2")
    b = np.concatenate([a[:7000], rng.integers(0, 49000, 3).astype("<u2"), a[7000:]])
    table = store.gear(49408)
    parts = []
    for x in (a, b):
        ends = store.cuts(x, table)
        starts = [0, *ends[:-1]]
        assert ends[-1] == len(x) and all(e - s <= store.LARGEST for s, e in zip(starts, ends, strict=True))
        parts.append({x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)})
    assert len(parts[0] & parts[1]) >= len(parts[0]) - 3


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_packing(spark, odd, tokenizer, tmp_path, which):
    docs = odd if which == "odd" else odd.limit(0)
    packed = packing.pack(packing.write_pieces(docs, str(tmp_path / which)))
    rows = packed.collect()
    want = sorted(tuple(i[k : k + 2048]) for i in (encoded(tokenizer, r.text, 0) for r in docs.collect()) for k in range(0, len(i), 2048))
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    if which == "odd":
        assert sum(len(r.ids) // 4 for r in packing.sequences(packed).collect()) == sum(map(len, want))


def test_plan_is_tight_and_uses_what_there_is():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        bins = packing.plan(histogram, 64)
        used = {}
        for need, n in bins:
            assert n > 0 and sum(k * v for k, v in need.items()) <= 64
            for k, v in need.items():
                used[k] = used.get(k, 0) + n * v
        assert used == histogram
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_plan_finds_complements_that_the_counts_allow():
    assert sorted(packing.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100)) == [({40: 1, 30: 1, 20: 1, 10: 1}, 1)]
    # Half of 100 is there once: the exact complement of 50 is 30 and 20.
    assert sorted(n for _, n in packing.plan({50: 1, 30: 1, 20: 1}, 100)) == [1]
    assert sum(n for _, n in packing.plan({60: 2, 20: 1, 40: 1, 10: 2}, 100)) == 2


def test_sequences_are_as_few_as_can_be(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.write_pieces(docs, str(tmp_path / "p")).select("length").collect()
    histogram = {}
    for r in pieces:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    assert sum(n for _, n in packing.plan(histogram)) == -(-sum(r.length for r in pieces) // packing.CAPACITY)


def plain_pii(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits)) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return [(pii.BASE[k], s, e) for s, k, e in sorted(out)]


def test_personal_data(spark, odd):
    rng = random.Random(1)
    parts = ["1", "4", "11", "25", ".", ".", "@", "a", "b-", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "x_", "%", "é", "iban ", "http://"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain_pii(text)
    rows = pii.digest_columns(pii.find(odd)).collect()
    assert len(rows) == odd.count() and pii.find(odd.limit(0)).count() == 0
    base = {r.doc_id: plain_pii(r.text or "") for r in odd.where("doc_id in (6, 7)").collect()}
    for r in rows:
        if r.doc_id in base:
            joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.n_phone == sum(k == "phone" for k, *_ in base[r.doc_id])
    assert [k for k, *_ in pii.spans("IBAN DE89370400440532013000 ok, account no: 12345678; http://u:p@h.org/x")][:2] == ["account", "account"]
    assert pii.masked("to a@b.co, 10.0.0.1!") == "to [EMAIL], [IP]!"
    for part, kinds in (("IBAN DE12", []), ("iban de12 ", []), ("http://", []), ("http://x ", []), ("1", []), ("1.", ["ip"]), ("a@", []), ("+1 ", []), ("10.0.0.1 ", ["ip"]), ("account 12345678 ", ["account"])):
        # A megabyte of each in well under a minute: the scan grows with the text.
        began = time.time()
        found = pii.spans(part * (1_000_000 // len(part)) + "5" * 5000)
        assert time.time() - began < 20 and {k for k, *_ in found} <= {*kinds}, part
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.where("text is null").count() == odd.where("text is null").count()


def plain_secrets(text):
    key = "(?:" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
    out = []
    for rank, (kind, pattern, least) in enumerate([("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16)]):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets(spark, odd):
    rng = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "z", "é", "😀", "secret", "x.y=", "\n", "K"]
    docs = frame(spark, ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(600)])
    want = {r.doc_id: plain_secrets(r.text) for r in docs.collect()}
    for r in secrets.digest_columns(secrets.judge(docs)).collect():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert secrets.judge(odd).count() == odd.count() and secrets.judge(odd.limit(0)).count() == 0
    many = "0123456789abcdef " * 50_000
    row = secrets.digest_columns(secrets.judge(frame(spark, [many]))).first()
    assert row.n_hex == 50_000 and row.base_sha256 == hashlib.sha256(",".join(f"hex:{17 * k}:{17 * k + 16}" for k in range(50_000)).encode()).hexdigest()
    copied = frame(spark, ["secret = abcdefghijkl", "secret = abcdefghijkl", "token: zyxwvutsrqpo"])
    got = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.digest_columns(secrets.judge(copied)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (1, 0)}
    # Added kinds stay where one owner has them, as often as that one likes.
    added = frame(spark, ["Bearer abcdefghijklmnopqrst", "x", "Bearer abcdefghijklmnopqrst", "Bearer zyxwvutsrqponmlkjihg", "Bearer zyxwvutsrqponmlkjihg"])
    kept = {r.doc_id: [s.kind for s in r.spans] for r in secrets.judge(added).collect()}
    assert kept == {0: ["bearer"], 1: [], 2: ["bearer"], 3: [], 4: []}


def test_edits(spark, odd, tokenizer):
    counts, rng = edits.counter(tokens.default_vocabulary()), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices(["word ", "a", "\n", ". ", "it's ", "x" * 200, "é", " "], k=rng.randint(0, 60)))
        leaves = edits.cut(text)
        tree = edits.CountTree(leaves, counts(leaves))
        for _ in range(4):
            at, removed, inserted = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 5, 600, 2000]), rng.choice(["", "q", " new ", "'s", "y" * 700])
            tree.edit(at, removed, inserted, counts)
            at = min(max(at, 0), len(text))
            text = text[:at] + inserted + text[at + removed :]
            assert tree.text() == text and tree.total() == len(encoded(tokenizer, text, 0)) - 1
            tree = edits.CountTree.stored(text, *tree.held())


def edited(text, changes):
    for at, removed, inserted in changes:
        at = min(max(at, 0), len(text))
        text = text[:at] + inserted + text[at + removed :]
    return text


def test_kept_trees(spark, odd, tokenizer, tmp_path):
    trees = edits.build(odd, str(tmp_path / "trees"))
    want = sorted((len(encoded(tokenizer, r.text, 0)) - 1, len(r.text or "")) for r in odd.collect())
    assert sorted((sum(r.tokens), sum(r.chars)) for r in trees.collect()) == want
    # A second round of edits starts from what the first one stored.
    once = edits.apply(edits.stated_edits(trees)).select("doc_id", "text", "chars", "tokens", "n_before")
    once.write.parquet(str(tmp_path / "again"))
    twice = edits.apply(edits.stated_edits(spark.read.parquet(str(tmp_path / "again"))))
    stated = lambda t: [(len(t) // 4, 0, " amended "), (len(t) // 2, 10, "revised text"), (len(t) * 3 // 4, 20, "")]
    texts = [edited(r.text or "", stated(r.text or "")) for r in odd.collect()]
    texts = [edited(t, stated(t)) for t in texts]
    assert sorted((r.text, r.n_tokens_edited) for r in twice.select("text", edits.total("tokens").alias("n_tokens_edited")).collect()) == sorted((t, len(encoded(tokenizer, t, 0)) - 1) for t in texts)
    assert edits.apply(edits.stated_edits(edits.build(odd.limit(0), str(tmp_path / "none")))).count() == 0
    same = edits.report(edits.apply(trees.withColumn("edits", F.lit(None).cast(edits.EDITS)))).where("n_tokens <> n_tokens_edited or n_chars_encoded_again > 0")
    assert same.count() == 0


def test_edit_counts_of_a_table(spark, sf, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_edit_aware_counts(spark, sf).collect():
        t = texts[r.doc_id]
        after = edited(t, [(len(t) // 4, 0, " amended "), (len(t) // 2, 10, "revised text"), (len(t) * 3 // 4, 20, "")])
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (len(encoded(tokenizer, t, 0)) - 1, len(encoded(tokenizer, after, 0)) - 1, len(after))


def plain_groups(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_near_duplicates(spark, odd):
    rng = random.Random(7)
    vocabulary = ["w%d" % k for k in range(500)]
    texts = [None, "", "one two", "ONE  two", "one two three", *(f"{thue_morse(2048, k)} b c d e f" for k in range(2))]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([30, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()}
    assert got == plain_groups(dict(enumerate(texts)))
    assert neardup.groups(odd.limit(0)).count() == 0 and neardup.groups(odd).count() == odd.count()
    kept = neardup.distinct(docs)
    assert kept.columns == docs.columns and kept.count() == sum(k == g for k, (_, g) in got.items())


def test_templates_meet_by_their_rarest_shingles(spark):
    """One template with few or many other words in it: buckets of many components, some of which have links."""
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(3000)]
    base, texts = rng.choices(vocabulary, k=200), [None, ""]
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    want = plain_groups(dict(enumerate(texts)))
    for limits in (neardup.Limits(), neardup.Limits(estimate=0, agree=0)):
        links = neardup.Links(frame(spark, texts).select("doc_id", "text"), limits)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in links.result().collect()} == want
    # From blocks alone, without leaders before them: small ones, so that there are several of each bucket.
    links = neardup.Links(frame(spark, texts).select("doc_id", "text"), neardup.Limits(agree=0))
    neardup.BLOCK, kept = 40, neardup.BLOCK
    more = links.confirm(links.in_blocks(links.unresolved(links.classes.select("cid", F.col("cid").alias("component")))))
    neardup.BLOCK = kept
    found = {r.cid: r.component for r in links.components(more).collect()}
    own = {r.cid: r.doc_id for r in links.rows.select(F.col("uid").alias("cid"), links.doc_id.alias("doc_id")).collect()}
    groups = {}
    for cid, component in found.items():
        groups.setdefault(component, set()).add(own[cid])
    large = {}
    for k, (n, g) in want.items():
        large.setdefault(g, set()).add(k)
    # Buckets of two were told by their leaders; equal sets are one class.
    assert all(any(g <= x for x in large.values()) for g in groups.values()) and max(map(len, groups.values())) >= 0.8 * max(map(len, large.values()))


def test_rows_are_told_apart_by_number(spark):
    a, b = "one two three four five six", "a different text of quite other words"
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, a, 5), (None, None, 6), (None, "", 7), (None, None, 8)], "doc_id long, text string, kept_id int")
    assert sorted(r.kept_id for r in neardup.distinct(docs).collect()) == [1, 3, 6, 7, 8] or sorted(r.kept_id for r in neardup.distinct(docs).collect()) == [1, 4, 6, 7, 8]
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.component_id is None for r in neardup.groups(nameless).collect()) == [True] * 8
    assert neardup.distinct(nameless).count() == 5
    clash = docs.withColumn("uid", F.lit(0)).withColumn("component", F.lit("x")).withColumn("n", F.lit(1)).withColumn("registers", F.lit(None).cast("binary"))
    assert neardup.distinct(clash).columns == clash.columns and neardup.distinct(clash).count() == 5


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**62, 2000).astype(np.uint64)
    for share in (0.95, 0.85, 0.6):
        b = np.concatenate([a[: int(2000 * 2 * share / (1 + share))], rng.integers(0, 2**62, 2000 - int(2000 * 2 * share / (1 + share))).astype(np.uint64)])
        k = neardup.sketch([a, b])
        assert abs(neardup.estimate(k[:1], k[1:], np.array([2000.0]), np.array([2000.0]))[0] - share) < 0.15
    both = neardup.sketch([np.union1d(a, b)])
    assert (np.maximum(k[0], k[1]) == both[0]).all()


def plain_hits(texts, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    out = {}
    for k, t in texts.items():
        w, hit, found = words(t), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for j in range(max(1, len(p) - 12) if p else 0):
                window = p[j : j + 13]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item))
        out[k] = (len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, odd):
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "é", "c1", "Dd", "x"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(20)] + [(3, "A b"), (30, None)]
    texts = [None, ""]
    for _ in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 2)):
            text += ". " + (items[rng.randrange(20)][1]).upper() + "! q"
        texts.append(text)
    docs, benchmark = frame(spark, texts), spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, term string")
    want = plain_hits(dict(enumerate(texts)), items)
    for r in decontaminate.digest_columns(decontaminate.find(docs, benchmark)).collect():
        n, hit, found, bad = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items_sha256, r.contaminated) == (n, hit, hashlib.sha256(found.encode()).hexdigest(), bad)
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, w in want.items() if not w[3]}
    assert decontaminate.find(odd, benchmark.limit(0)).where("n_hit > 0 or size(near_ids) > 0").count() == 0
    assert decontaminate.find(odd.limit(0), benchmark).count() == 0 and decontaminate.find(odd, benchmark).count() == odd.count()
    clash = docs.withColumn("uid", F.lit(0)).withColumn("words", F.lit("x")).withColumn("bad_id", F.lit(1)).withColumn("n_hit", F.lit(1))
    assert decontaminate.clean(clash, benchmark).columns == clash.columns and decontaminate.clean(clash, benchmark).count() == clean.count()


def plain_near(texts, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    out = {}
    for k, t in texts.items():
        w, out[k] = words(t), []
        for item, phrase in items:
            p = words(phrase)
            stretches = [set(w[i : i + len(p) + decontaminate.SLACK]) for i in range(len(w))]
            if len(set(p)) >= decontaminate.LEAST_NEAR and any(100 * len(s & set(p)) >= decontaminate.NEAR * len(set(p)) for s in stretches):
                out[k].append(str(item))
        out[k] = sorted(set(out[k]))
    return out


def test_near_items(spark):
    """Items with words replaced, left out, put in or moved, against a plain search."""
    rng = random.Random(9)
    vocabulary = ["w%d" % k for k in range(90)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([4, 8, 20, 40])))) for k in range(12)]
    texts = []
    for _ in range(150):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(copy) // 3)):
            at = rng.randrange(len(copy))
            change = rng.randrange(4)
            if change == 0:
                copy[at] = rng.choice(vocabulary)
            elif change == 1 and len(copy) > 1:
                del copy[at]
            elif change == 2:
                copy.insert(at, rng.choice(vocabulary))
            else:
                copy.insert(rng.randrange(len(copy)), copy.pop(at))
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 30)), *copy, *rng.choices(vocabulary, k=rng.randint(0, 30))]))
    docs, benchmark = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = plain_near(dict(enumerate(texts)), items)
    got = {r.doc_id: r.near_ids for r in decontaminate.find(docs, benchmark).collect()}
    assert got == want and sum(map(len, want.values())) > 50
    # As tables that are joined by shuffle, and with shared windows.
    decontaminate.SENT, kept = 0, decontaminate.SENT
    more = spark.createDataFrame([*items, (50, f"{items[3][1]} x y"), (51, f"z {items[3][1]}")], "item_id long, text string")
    again = {r.doc_id: (r.near_ids, r.item_ids, r.n_hit) for r in decontaminate.find(docs, more).collect()}
    decontaminate.SENT = kept
    assert again == {r.doc_id: (r.near_ids, r.item_ids, r.n_hit) for r in decontaminate.find(docs, more).collect()}


def test_a_whole_window_anywhere_is_a_leak(spark):
    item = " ".join(f"word{k}" for k in range(13))
    texts = [item + " filler" * 9000, "filler " * 9000, "two words " + "filler " * 9000, "two words", None]
    docs, benchmark = frame(spark, texts), spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark, decontaminate.leaks()).collect()} == {1, 2, 4}
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == {0, 1, 2, 4}


def test_chat(spark):
    rng = random.Random(6)
    template = chat.Template()
    pattern = chat._pattern(template)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "[TEXT]"]), "".join(rng.choices(["<", "s", ">", "/", "[INST]", "</s>", "\\", "[", "INST]", "<<SYS>>", "a"], k=rng.randint(0, 9)))) for _ in range(3)]
        formatted = "".join(p for role, text in turns for p, _ in chat.segments_of(role, text, template, pattern))
        assert chat.parse(formatted, template) == turns
    rows = [(1, 0, "user", "hi [INST]", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (2, 0, None, "x</s>", 1), (None, 5, "user", "n", 1), (3, 0, "system", "s", 0), (3, 1, "user", "u", 0), (3, 2, "assistant", "\\a", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, None} and got[3].valid and not got[1].valid and got[1].n_turns == 3
    assert got[3].loss_sha256 == hashlib.sha256(b"\\a").hexdigest() and got[3].loss_chars == 2
    assert got[2].turns_sha256 == hashlib.sha256("\nx</s>\n".encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_toxicity(spark, odd):
    rng = random.Random(8)
    fill = ["w%d" % k for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        words = rng.choices(fill, k=30)
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append(" ".join(words))
        labels.append((k, int(insult and group), "x"))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    machine = toxicity.train(docs, known)
    scored = {r.doc_id: r for r in toxicity.toxic_or_not(docs, machine).collect()}
    held = [(labels[k][1], r.score) for k, r in scored.items() if r.held_out]
    bad, good = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in scored.items())
    assert toxicity.toxic_or_not(odd, machine).count() == odd.count() and toxicity.toxic_or_not(odd.limit(0), machine).count() == 0
    none = toxicity.train(docs, known.limit(0))
    assert max(r.score for r in toxicity.toxic_or_not(odd, none).collect()) < 1e-9
    full = toxicity.score(docs, machine)
    assert full.columns == [*docs.columns, "score_"] and {r.score for r in full.collect()} == {9.0}
    assert toxicity.fit(docs, machine).columns == docs.columns
    # The sum over all pairs, term by term.
    for text in (rows[0], rows[1], "insult group", "", "insult insult w1"):
        k = machine.slots(text)
        plain = machine.w0 + sum(machine.w[i] for i in k) + sum(machine.v[i] @ machine.v[j] for i in k for j in k if i < j)
        assert abs(machine.logits([k])[0] - plain) < 1e-9


def test_pairs_that_additive_weights_cannot_fit(spark):
    rng = random.Random(1)
    fill = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(300)]
    texts, labels = [], []
    for k in range(1800):
        # Each word alone says nothing: half of the texts with it are toxic, and half of those without.
        insult, group = k % 2 == 1, k // 2 % 2 == 1
        texts.append((k, " ".join(rng.choices(fill, k=20) + ["insult"] * insult + ["group"] * group)))
        labels.append((k, int(insult == group)))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, known)
    held = [(labels[r.doc_id][1], r.predicted) for r in toxicity.toxic_or_not(docs, machine).where("held_out").collect()]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype("float32")
    x[100:400] = x[100]
    rows = [(k, v.tolist(), 1, "s") for k, v in enumerate(x)] + [(9000, None, 1, "s"), (9020, [0.0] * 16, 1, "s"), (9040, [1.0, None] + [0.0] * 14, 1, "s"), (9060, [float("nan")] * 16, 1, "s"), (9080, [1.0], 1, "s")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in neighbours.search(vectors, lambda k: k % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    y = x.astype(float)
    for q, found in got.items():
        score = (y * y[q]).sum(1)
        near = [k for k in np.lexsort((np.arange(3000), -score)) if k != q][:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and all(abs(s - score[k]) < 1e-9 for _, k, s in found)
        hit += len({k for _, k, _ in found} & set(near))
        if 100 <= q < 400:
            assert [k for _, k, _ in sorted(found)] == near
    assert hit >= 0.9 * 20 * len(got)
    assert neighbours.search(vectors.limit(0), lambda k: k % 20 == 0).count() == 0
    few = vectors.where("vec_id in (20, 21)")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(few, lambda k: k % 20 == 0).collect()] == [(20, 21)]


def test_contract_columns(spark, sf):
    wanted = {
        "op1": ["doc_id", "start", "n_tokens", "ids_crc32"], "op2": ["query_id", "rank", "vec_id", "score"], "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op4": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op6": ["doc_id", "n_segments", "n_tokens"],
        "op7": ["doc_id", "n_shingles", "component_id", "kept"], "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op9": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op10": ["doc_id", "held_out", "score", "predicted"],
    }
    assert [k.split("_")[0] for k in queries.queries()] == list(wanted)
    for name, f in queries.queries().items():
        df = f(spark, sf)
        columns = wanted[name.split("_")[0]]
        assert df.columns[: len(columns)] == columns, name
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    import oracle

    assert oracle.difference(spark, oracle.views(sf), queries.queries()[name], queries.oracle_sql()[name], sf) == ""


def test_identifiers_after_cues():
    found = {
        "Passport AB1234567 was lost": "AB1234567",
        "account no: GB12345678.": "GB12345678",
        "IBAN GB29 NWBK 6016 1331 9268 19, thanks": "GB29 NWBK 6016 1331 9268 19",
        "IBAN DE89370400440532013000 2 days": "DE89370400440532013000",
        "iban: de89 3704 0044 0532 0130 00 to pay": "de89 3704 0044 0532 0130 00",
        "Tax ID 123-45-6789": "123-45-6789",
        "National ID: 12345678": "12345678",
        "iBaN DE89370400440532013000": "DE89370400440532013000",
    }
    for text, value in found.items():
        assert [text[s:e] for k, s, e in pii.spans(text) if k == "account"] == [value], text
    for text in ("IBAN DE88370400440532013000", "IBAN GB29 NWBK 6016", "IBAN ZZ89370400440532013000", "Passport AB12345"):
        assert not [s for s in pii.spans(text) if s[0] == "account"], text
    assert "link" in [k for k, *_ in pii.spans("HTTPS://me@example.org")]


def test_whole_keys_and_logins(spark):
    def key(c):
        return "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + "\n".join([c * 64] * 25) + "\n-----END RSA PRIVATE KEY-----"

    texts = ["see " + key("a") + " end", key("b"), "redis://:hunter22@host", f"https://u:{'t' * 400}@host", f"https://{'u' * 90}:secretword@host", "-----BEGIN PRIVATE KEY-----\n" + "\n".join(["Q" * 64] * 9) + " cut off"]
    docs = spark.createDataFrame([(k, t, "en", f"src{k}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind in ("key", "login")] for r in secrets.judge(docs).collect()}
    assert got[0] == [("key", key("a"))] and got[1] == [("key", key("b"))]
    assert got[2] == [("login", "://:hunter22@")] and got[3] == [("login", f"://u:{'t' * 400}@")] and got[4] == [("login", f"://{'u' * 90}:secretword@")]
    assert got[5] == [("key", texts[5][: -len(" cut off")])]
