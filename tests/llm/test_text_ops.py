"""Language ID, quality, BPE and secrets: brute force, held-out accuracy, edge cases."""

import gc
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe, langid, quality, secrets

from .data import documents, empty, texts

SAMPLE = {"en": "the and with that this have from were been their would which", "de": "der die und nicht sich auch werden haben eine über", "fr": "les des une dans pour qui être avec été sont"}


def out(spark_id):
    return zlib.crc32(str(spark_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        lang = rnd.choice(list(SAMPLE))
        rows.append((k, " ".join(rnd.choice(SAMPLE[lang].split()) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the with", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, labelled):
    got = {r["doc_id"]: r for r in langid.identify(labelled).collect()}
    truth = {r["doc_id"]: r["lang"] for r in labelled.collect()}
    assert all(got[k]["held_out"] == out(k) for k in truth)
    held = [k for k in range(400) if out(k)]
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.98
    assert (got[1000]["lang_pred"], got[1000]["score"]) == ("und", 0.0) and got[1001]["lang_pred"] == "und"
    assert got[1002]["lang_pred"] == "en" and 0 < got[1002]["score"] <= 1
    kept = langid.keep_identified(labelled)
    assert kept.columns == labelled.columns and kept.count() == 401


def test_language_id_ignores_held_out_labels(spark, labelled):
    from pyspark.sql import functions as F

    spoiled = labelled.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(spoiled).collect())) == sorted(map(tuple, langid.identify(labelled).collect()))


def test_gram_counts_do_not_depend_on_slices(monkeypatch):
    text = "Übergröße, the 12 -- end " * 40
    whole = langid.gram_counts(text, 12)
    monkeypatch.setattr(langid, "SLICE", 64)
    cut = langid.gram_counts(text, 12)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1]


def test_hostile_tables(spark):
    docs = documents(spark)
    for make in (langid.identify, lambda d: bpe.encode_documents(d, _spec()), secrets.find_secrets, lambda d: quality.score_documents(d, spark.createDataFrame([], "doc_id long, quality int"))):
        got = make(docs)
        assert got.count() == docs.count() and got.columns[0] == "doc_id"
        assert make(empty(spark, docs)).count() == 0
    assert langid.identify(documents(spark).drop("lang").selectExpr("*", "cast(null as string) AS lang")).filter("lang_pred <> 'und'").count() == 0


def test_quality_learns_junk(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        good = rnd.random() < 0.7
        words = [rnd.choice(SAMPLE["en"].split()) for _ in range(60)]
        rows.append((k, ". ".join(words) if good else "".join(w + rnd.choice(["$$$", "###", " | "]) for w in words)))
        labels.append((k, int(good)))
    rows += [(9000, None), (9001, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, marks).collect()}
    held = [k for k, _ in labels if out(k)]
    assert np.mean([got[k]["predicted"] == labels[k][1] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"]
    one_class = quality.score_documents(docs, marks.filter("quality = 1"))
    assert one_class.select("score").distinct().count() == 1


def test_boosting_finds_interactions():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x[:2000], y[:2000], rounds=20, n_pairs=2)
    assert model.pairs[0] == (0, 1) and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def _spec():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(_spec())
    reference.no_truncation()
    reference.no_padding()
    with open(_spec(), encoding="utf-8") as f:
        return reference, bpe.WordBpe(f.read())


def same(pair, text):
    reference, own = pair
    ids = reference.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.encode_both(text)[1] == reference.decode(ids, skip_special_tokens=False)


@given(st.lists(st.sampled_from(["a", "e", "\u0301", "\u0323", "\u0338", "\u07fd", "\u1abf", "\u1acb", "\U00011935", "\U00011930", "\U0001193e", "\U00010eab", " ", "\u3099", "\u304b"]), max_size=9).map("".join))
@settings(max_examples=300, deadline=None)
def test_bpe_composes_like_the_library(pair, text):
    same(pair, text)


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_matches_library(pair, text):
    same(pair, text)


def test_bpe_matches_library_on_every_code_point(pair):
    reference, own = pair
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(chars), 20_000):
        texts = [f"a{c}b1{c}{c} {c}" for c in chars[at:at + 20_000]]
        for c, got in zip(chars[at:], reference.encode_batch(texts, add_special_tokens=False), strict=False):
            if own.encode(f"a{c}b1{c}{c} {c}") != got.ids:
                wrong.append(f"{ord(c):x}")
    assert not wrong, (len(wrong), wrong[:50])


def test_bpe_refuses_what_it_cannot_follow():
    import json

    with open(_spec(), encoding="utf-8") as f:
        data = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"decoder": {"type": "ByteLevel"}}):
        with pytest.raises(ValueError):
            bpe.word_pattern(data | change)


def test_bpe_matches_library_on_documents(pair):
    for text in [t for t in texts(4) if t is not None] + ["<|endoftext|>x<|startoftext|>", "I'LL'll 's'S", "ΑΣ Σ. ςσ", "1234 ½²", "e\u0301\u0301 \u1e9b\u0323", "\U00011935\U00011930\U00011930 \U00011938 \uA7DCΣ"]:
        same(pair, text)


def test_bpe_scan_and_heap_agree(pair):
    rnd = random.Random(2)
    for _ in range(100):
        parts = pair[1]._start("".join(rnd.choice("theanig") for _ in range(rnd.randrange(1, 120))))
        assert pair[1]._scan(list(parts)) == pair[1]._heap(list(parts))


def test_bpe_digests(spark, pair):
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string"), _spec(), with_ids=True).collect()}
    ids = pair[1].encode("Hello world")
    assert got[1]["ids"] == ids and got[1]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids"] == [] and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_words_are_forgotten_with_the_task(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} again w{k % 7}") for k in range(50)], "doc_id long, text string").coalesce(1)

    def held(batches):
        n = [sum(len(m) + len(getattr(m, "before", ())) for m in gc.get_objects() if type(m).__name__ == "WordBpe") for _ in batches]
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    assert bpe.encode_documents(docs, _spec()).count() == 50
    rows = spark.range(0, 8, numPartitions=8).mapInArrow(held, "n long").collect()
    assert rows and not any(r["n"] for r in rows)
    with open(_spec(), encoding="utf-8") as f:
        plain = bpe.WordBpe(f.read())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    with open(_spec(), encoding="utf-8") as f:
        small = bpe.WordBpe(f.read())
    for k in range(200):
        text = f"some words x{k % 9}, y{k % 4} come again, z{k}"
        assert small.encode_both(text) == (b"".join(plain._word(w)[0] for c in text.split() for w in plain.words.findall(c)), plain.encode_both(text)[1])
        assert len(small) <= 5 and len(small.before) <= 5


def brute_secrets(text):
    found = []
    for k, (pattern, group, least) in enumerate(((r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "token", "Secret", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123456789", "ſecret", "\n", "é", "x"]), max_size=25).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans_match_brute_force(text):
    base, every = secrets.scan(text)
    assert secrets.tell(base).split(",") == (brute_secrets(text) or [""])
    assert set(base) <= set(every)


def test_named_literals_and_constants():
    text = 'K = "q9X!fj2 LLs8"\nexport DB_PWD: string = \'zz!8#kQw\'\nconst a = `n0t,hing!` \nclient.secretKey = K\n{"private-key": "p@ss,word9"}\ncolor = "q9X!fj2"\n'
    _, every = secrets.scan(text)
    named = {text[s:e] for s, k, e, _ in every if k == 3}
    assert named == {"q9X!fj2 LLs8", "zz!8#kQw", "p@ss,word9"}
    assert secrets.redact(text).count("[REDACTED]") == 3 and "n0t,hing!" in secrets.redact(text)
    assert secrets.scan('password_hint = "the name of your first dog"')[1] == []
    assert secrets.redact('token = "abcdef0123456789abcdef0123456789"') == 'token = "[REDACTED]"'
    assert secrets.redact(None) is None and secrets.redact("clean") == "clean"


def test_unquoted_values_of_configuration_lines():
    def named(text):
        return [text[s:e] for s, k, e, _ in secrets.scan(text)[1] if k == 3]

    assert named("# settings\nDB_PWD=Xk29vQ77LmPz81\nexport ENCRYPTION_KEY=wJalrXUtnFEMI  # old\nMODE=production\n") == ["Xk29vQ77LmPz81", "wJalrXUtnFEMI"]
    assert named("[db]\r\nuser = admin\r\npwd = zz!8#k+Qw/9== ; changed\r\n") == ["zz!8#k+Qw/9=="]
    assert named("db:\n  private_key: MIIEowIBAAKC\n  db.pwd: 9fK2vQ77LmPz81\n  - passphrase: q9X!fj2LLs8\n") == ["MIIEowIBAAKC", "9fK2vQ77LmPz81", "q9X!fj2LLs8"]
    assert named("BASE=Xk29vQ77LmPz81\nDB_PWD=${BASE}\n") == named("BASE=Xk29vQ77LmPz81\nDB_PWD=BASE\n") == ["Xk29vQ77LmPz81"]
    assert secrets.redact("DB_PWD=Xk29vQ77LmPz81\nx") == "DB_PWD=[REDACTED]\nx"
    assert named("import os\npwd = read_pwd\npwd = os.getenv(name)\n") == named("pwd: string\npwd: the words of a sentence\n") == named("pwd = changeme\npwd=${OTHER}\npwd=$OTHER") == []


def test_redacted_documents_keep_columns(spark):
    docs = documents(spark, [(1, "a token = abcdefgh b"), (2, "clean"), (3, None)], extra=False)
    got = {r["doc_id"]: r for r in secrets.redact_documents(docs).collect()}
    assert got[1]["text"] == "a token = [REDACTED] b" and got[1]["n_chars"] == 22 and got[2]["text"] == "clean" and got[3]["text"] is None
    assert secrets.redact_documents(docs).columns == docs.columns


SECRET = "Xk29vQ77LmPz81"


@pytest.mark.parametrize("text", [
    "DB_PWD=%s", "db_pwd: %s", "[db]\npwd = %s", "[db] pwd = %s", "<pwd>%s</pwd>", "<pwd kind='a'><![CDATA[%s]]></pwd>", '<add key="DbPwd" value="%s"/>', 'pwd = """%s"""', "pwd = \'\'\'%s\'\'\'",
    'connect(host="h", pwd="%s")', 'client.set_pwd("%s")', 'setPassphrase("%s")', 'os.environ.setdefault("DB_PWD", "%s")', 'cfg["pwd"] = "%s"', 'pwd = KEYVAL\nfoo = 1\nKEYVAL = "%s"\n',
    'K = "%s"\npwd = K;', "pwd: |\n  %s\n", 'const pwd: string = "%s";', '{"pwd": "%s"}', 'K = load()\nK = "%s"\npwd = K', 'A = B\npwd = A\nB = "%s"'])
def test_secrets_in_many_syntaxes(text):
    text = text % SECRET
    at = text.index(SECRET)
    assert (at, at + len(SECRET)) in secrets.named_spans(text)
    assert SECRET not in secrets.redact(text)


@pytest.mark.parametrize("text", [
    'K = "%s"\nK = load()\npwd = K\n', 'K = "%s"\nK = 5\npwd = K\n', 'K = "%s"\nname = K\nthe key: is a thing', "a = b\nb = a\npwd = a", 'get_pwd("%s")', 'pwd = load()\nx = "%s"'])
def test_what_is_no_secret(text):
    assert secrets.named_spans(text % SECRET if "%" in text else text) == []


def test_adjacent_literals_are_one_value():
    for text in ('pwd = "Xk29vQ7" "7LmPz81"', 'pwd = ("Xk29vQ7"\n    "7LmPz81")', 'pwd = "Xk29vQ7" + "7LmPz81"'):
        assert [text[s:e] for s, e in secrets.named_spans(text)] == ["Xk29vQ7", "7LmPz81"]
    assert [s for s in secrets.named_spans('pwd: "Xk29vQ77LmPz81"\n"user": "somebody-else-7712"')] == [(6, 20)]


def test_very_long_texts_are_scanned_whole():
    quiet = "some words of prose and more, " * 40_000
    text = quiet + 'pwd = "%s"\n' % SECRET + "key=" + "\\" * 100_001 + quiet + 'x="' * 20_000
    assert SECRET not in secrets.redact(text) and len(secrets.redact(text)) > len(text) - 200_000


def plain_grams(text):
    """Grams of 1 to 3 characters of a text, by the definition: letters in lower case, other runs one space, a space at both ends."""
    chars = []
    for c in text:
        if c.isalpha():
            chars.append(ord((c.lower() or c)[0]))
        elif chars and chars[-1] != 32:
            chars.append(32)
    if not chars:
        return []
    chars = [32, *chars, *([] if chars[-1] == 32 else [32])]
    return [tuple(chars[k:k + n]) for n in (1, 2, 3) for k in range(len(chars) - n + 1) if (n > 1 or chars[k] != 32)]


def plain_bucket(gram, bits):
    """The bucket of a gram, in plain integers."""
    m = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    h = gram[-1] * m[0] % (1 << 32)
    if len(gram) == 2:
        h ^= gram[0] * m[1] % (1 << 32)
    if len(gram) == 3:
        h ^= (gram[1] * m[1] % (1 << 32)) ^ (gram[0] * m[2] % (1 << 32))
    h = (h + len(gram) * 0x27D4EB2F) * m[2] % (1 << 32)
    h ^= h >> 15
    return (h * m[0] % (1 << 32)) >> (32 - bits)


def test_language_scores_match_plain_naive_bayes(spark, labelled):
    import math
    from collections import Counter

    bits, alpha = 12, 0.5
    model = langid.fit(labelled, bits=bits, alpha=alpha)
    counts, docs = {}, Counter()
    for r in labelled.collect():
        if r["lang"] and r["text"] and not out(r["doc_id"]):
            docs[r["lang"]] += 1
            counts.setdefault(r["lang"], Counter()).update(plain_bucket(g, bits) for g in plain_grams(r["text"]))
    asked = [t for t in texts(14) if t] + [None, "", "12 !", "a", "é", " b ", "x" * 500] + [r["text"] for r in labelled.limit(20).collect()]
    for text, (lang, score) in zip(asked, model.score_batch(asked), strict=True):
        grams = [plain_bucket(g, bits) for g in plain_grams(text or "")]
        if not grams:
            assert (lang, score) == ("und", 0.0)
            continue
        logs = {}
        for k in sorted(counts):
            total = sum(counts[k].values()) + alpha * (1 << bits)
            logs[k] = math.log(docs[k] / sum(docs.values())) + sum(math.log((counts[k][b] + alpha) / total) for b in grams)
        best = max(logs.values())
        assert abs(score - 1 / sum(math.exp(v - best) for v in logs.values())) < 1e-3 and logs[lang] > best - 1e-3 * len(grams)


def test_language_batches_match_single_texts(spark, labelled, monkeypatch):
    model = langid.fit(labelled)
    asked = texts(15) + ["word " * 3000, "-", "ß", None]
    single = [model.score(t) for t in asked]
    for size in (50, 1 << 18):
        monkeypatch.setattr(langid, "SLICE", size)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(model.score_batch(asked), single, strict=True))


def test_boosted_trees_match_exhaustive_search():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        n = int(rnd.integers(1, 9))
        g, h, penalty = rnd.normal(size=n), rnd.random(n) + 0.1, 2.0

        def worth(parts):
            return sum(g[p].sum() ** 2 / (h[p].sum() + penalty) for p in parts)

        cuts = [(worth([slice(0, k), slice(k, n)]) - worth([slice(0, n)]), k) for k in range(1, n)]
        gain, at = quality._cut(g, h, penalty)
        assert (gain, at) == (0.0, 0) if not cuts else abs(gain - max(cuts)[0]) < 1e-9 and at == max(cuts, key=lambda c: (c[0], -c[1]))[1]


def test_quality_scores_are_sums_of_looked_up_values():
    import bisect
    import math

    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.boost(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [bisect.bisect_right(c.tolist(), v) for c, v in zip(model.cuts, row, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i] // 2, bins[j] // 2] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_urls_of_any_length_and_no_rules(spark):
    from corvane.llm import urls

    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000), (1, None)], "page_id long, url string")
    rules = spark.sql("SELECT * FROM VALUES ('com', '/x', 'block') AS t(host, path, verdict)")
    assert sorted((r["verdict"], len(r["path"])) for r in urls.judge(pages, rules).collect()) == [("allow", 0), ("block", 200_001)]
    assert {r["verdict"] for r in urls.judge(pages, rules.filter("false")).collect()} == {"allow"} and urls.judge(pages.filter("false"), rules).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ('pwd = x["a"]', []),
    ("pwd = load(x)", []),
    ('pwd = ["hunter22x9","abcdefg123"]', ["hunter22x9", "abcdefg123"]),
    ('"pwd": [\n  "hunter22x9",\n  "abcdefg123"\n]', ["hunter22x9", "abcdefg123"]),
    ('export PWD="/usr/local/bin"', []),
    ('dbPwd = c ? "hunter22x9" : "other99zz"', ["hunter22x9", "other99zz"]),
    ('pwd = "hunter22x9" if c else "other99zz"', ["hunter22x9", "other99zz"]),
    ('pwd = os.environ.get("X") or "hunter22x9"', ["hunter22x9"]),
    ('c := Config{Pwd: "hunter22x9", Name: "bob"}', ["hunter22x9"]),
    ("a1=hunter22x9\na2=a1+a1\npwd=a2", ["hunter22x9"]),
    ("DB_PWD=Xk29+vQ77Lm/z81", ["Xk29+vQ77Lm/z81"]),
])
def test_literals_of_lists_choices_and_defaults(text, want):
    assert [text[s:e] for s, e in secrets.named_spans(text)] == want


@pytest.mark.parametrize(("text", "n"), [
    ("a1 = 'hunter22x9'\n" + "\n".join(f"a{k + 1}=a{k}+a{k}" for k in range(1, 60)) + "\npwd = a60", 1),
    ("s = ''\n" + "s = s + 'a7Zq'\n" * 20_000 + "pwd = s", 20_001),
    ("pwd = ''\n" + "pwd = pwd + 'a7Zq'\n" * 10_000, 10_001),
    ("\n".join(f"a{k} = " + " + ".join([f"a{k + 1}"] * 20) for k in range(60)) + "\na60 = 'hunter22x9'\npwd = a0", 0),
    ("\n".join(f"a{k} = a{k + 1}" for k in range(3000)) + "\na3000 = 'hunter22x9'\npwd = a0", 0),
    ("pwd = a0\n" + "\n".join(f"a{k} = a{k + 1}" for k in range(3000)) + "\na3000 = 'hunter22x9'", 1),
    ("pwd = a0\n" + "\n".join(f"a{k} = a{k + 1} + a{k + 2}" for k in range(80)) + "\na80 = 'hunter22x9'\na81 = 'x'", 2),
    ("pwd " + "a." * 100_000, 0),
    ("pwd = a + b\na = b\nb = a\n" * 500, 0),
])
def test_hostile_constants_take_time_in_proportion(text, n):
    """Values share what they are joined from, and a name further on is worked out once."""
    import time

    began = time.perf_counter()
    found = secrets.named_spans(text)
    assert time.perf_counter() - began < 6  # a second or so
    if n:
        assert len(found) in (n, n - 1)  # an empty literal has a place, too
    secrets.redact(text)


def test_a_joined_value_scores_as_its_text():
    rnd = random.Random(3)
    for _ in range(200):
        parts = ["".join(rnd.choice("abcXYZ019 \n<>${}%x") for _ in range(rnd.randrange(0, 40))) for _ in range(rnd.randrange(1, 5))]
        joined = secrets.Value.literal((0, 0, parts[0]))
        for p in parts[1:]:
            joined = joined + secrets.Value.literal((0, 0, p))
        text = "".join(parts)
        n, whole = len(text), secrets.literal_score(text)
        assert joined.score() == pytest.approx(whole)
        if whole:
            assert whole == pytest.approx(min(1.0, 0.3 - sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) / 5))


def test_another_unicode_is_refused(monkeypatch):
    bpe.unicode_classes.cache_clear()
    monkeypatch.setattr(bpe, "UNICODE", "1.1")
    with pytest.raises(RuntimeError, match="Unicode"):
        bpe.unicode_classes()
    bpe.unicode_classes.cache_clear()
