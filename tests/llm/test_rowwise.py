"""Operators that look at one text at a time: brute force, exact round trips and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quadrat.llm import decontaminate, language, pieces, quality, secrets
from tests.llm.conftest import PROSE, crc

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


def texts(seed, count=3000):
    rnd = random.Random(seed)
    parts = [*"abehnt01-=/\tAS", " ", " ", "\n", "é", "ß", "▁", "😀", "中", "\x00", "ing", "tion", "the", "    ", "​", "한", "�", "𐍈"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(count)] + ["", " ", " " * 5000, "a" * 20_000, "▁" * 900 + "x"]


def test_pieces_equal_the_library(vocabulary, library):
    codec = pieces.Codec(vocabulary)
    for text in texts(1):
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_decoding_any_ids_equals_the_library(vocabulary, library):
    codec, rnd = pieces.Codec(vocabulary), random.Random(2)
    for _ in range(3000):
        ids = [rnd.randrange(700) for _ in range(rnd.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_of_odd_rows(odd, none, vocabulary, library):
    out = pieces.encode(odd, vocabulary, ids=True).collect()
    assert len(out) == odd.count()
    for r, text in zip(out, [r.text or "" for r in odd.select("text").collect()], strict=True):
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode(none, vocabulary).collect() == []


def plain_counts(text):
    """The counts of op1 straight from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_quality_counts_and_verdict(odd, none, spark):
    rnd = random.Random(3)
    more = [(i, "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\x1c", "a b c "]) for _ in range(rnd.randint(0, 300)))) for i in range(200)]
    for df in (odd, spark.createDataFrame(more, "doc_id long, text string")):
        order = quality.cascade(df)
        assert {r.name for r in order} == {r.name for r in quality.RULES}
        for r, text in zip(quality.judge(df, order).collect(), [r.text or "" for r in df.select("text").collect()], strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
            assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
            assert r.kept == (not any(rule.rejects(quality.Measures(text)) for rule in quality.RULES))
            assert (r.rejected_by is None) == r.kept
    assert quality.judge(none, quality.cascade(none)).collect() == []


def test_the_cascade_puts_cheap_rejections_first(spark):
    import time

    slow = quality.Rule("slow", lambda m: (time.sleep(0.002), len(m.text) > 3)[1])
    quick = quality.Rule("quick", lambda m: len(m.text) > 3)
    never = quality.Rule("never", lambda m: False)
    df = spark.createDataFrame([(i, "long text") for i in range(20)], "doc_id long, text string")
    assert [r.name for r in quality.cascade(df, rules=[slow, never, quick])][0] == "quick"


def plain_base(text):
    """Base spans by the definition: match, then drop what is too short."""
    found = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[1]) >= 6 else []
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(found)]


def test_secret_base_spans(odd, spark, none):
    rnd = random.Random(4)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "x9Y8", "deadbeef", "0123456789abcdef", "AKIA", "ABCD1234EFGH5678", "é", "\n", "ſecret", "toKen"]
    more = spark.createDataFrame([(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(2000)], "doc_id long, text string")
    for df in (odd, more):
        for r, text in zip(secrets.scan(df).collect(), [r.text or "" for r in df.select("text").collect()], strict=True):
            base = plain_base(text)
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            kinds = Counter(x.split(":")[0] for x in base)
            assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
            spans = r.spans.split(",") if r.spans else []
            assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == base
    assert secrets.scan(none).collect() == []


def test_literals_follow_names():
    text = 'seed = "k3Jf92mQp0Zr"\nname = "Some Person"\nDB_PASSWD = seed\nmax_tokens = "a1b2c3d4e5"\n<privateKey>Zx81-Qw72-Lm</privateKey>\n'
    found = {(k, text[a:b]) for k, a, b in secrets.lexed_spans(text)}
    assert found == {("constant", "k3Jf92mQp0Zr"), ("literal", "Zx81-Qw72-Lm")}
    assert secrets._masked(text, "*").count("*") == 2


def test_masked_texts_hold_no_base_span(odd):
    out = secrets.mask(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(not plain_base(r.text or "") for r in out.select("text").collect())


def brute_tiles(a, b, shortest):
    """Greedy string tiling by its definition."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return sorted(found)
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        found.append((i, j, n))


def test_tiles_are_greedy():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randint(1, 4) for _ in range(rnd.randint(0, 45))] for _ in range(2))
        mine = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(mine) == brute_tiles(a, b, 3)


def test_leaks(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "zeta eta theta iota kappa lambda mu - then Alpha, beta gamma delta epsilon"
    marks = spark.createDataFrame([(1, item), (2, PROSE), (3, "mini item"), (4, None), (5, ""), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, moved), (3, "alpha beta gamma delta"), (4, "a mini item here"), (5, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.coverage, 2), r.n_tiles) for r in decontaminate.find_leaks(docs, marks).collect()}
    assert found == {(1, 1): (1.0, 1), (2, 1): (1.0, 2), (4, 3): (1.0, 1)}
    assert found == {(r.doc_id, r.item_id): (round(r.coverage, 2), r.n_tiles) for r in decontaminate.find_leaks(docs, marks, block_bytes=100).collect()}
    assert {r.doc_id for r in decontaminate.find_leaks(odd, marks).collect()} == {0, 1, None, 10}
    assert decontaminate.find_leaks(none, marks).count() == decontaminate.find_leaks(odd, marks.limit(0)).count() == 0
    kept = decontaminate.keep(odd, marks)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {2, 3, 4, 5, 6, 7, 8, 9, None}


def plain_bits(text, grams, symbol):
    """Code length by the definition: escape down the contexts, one byte after the other."""
    from math import log2

    data = [int(symbol[b]) for b in language.letters(text)]
    total = 0.0
    for i in range(1, len(data)):
        context = tuple(([0] * language.ORDER + data[:i])[-language.ORDER :])
        for k in range(language.ORDER, -1, -1):
            row = Counter()
            for gram, n in grams.items():
                digits = tuple(gram // language.SYMBOLS**j % language.SYMBOLS for j in range(language.ORDER, -1, -1))
                if digits[language.ORDER - k : language.ORDER] == context[language.ORDER - k :]:
                    row[digits[-1]] += n
            if row:
                size = len(row) + sum(row.values())
                if row[data[i]]:
                    total += log2(size / row[data[i]])
                    break
                total += log2(size / len(row))
        else:
            total += log2(language.SYMBOLS)
    return total


def test_code_lengths_equal_the_definition(monkeypatch):
    import numpy as np

    monkeypatch.setattr(language, "CHUNK", 7)
    symbol = np.full(256, language.SYMBOLS - 1)
    symbol[32] = 0
    symbol[97:107] = range(1, 11)
    grams = {}
    for name, text in (("x", "abcab cab abba"), ("y", "jihgf fed dede jig")):
        context, s = language._grams(language.letters(text), symbol)
        grams[name] = dict(Counter((context * language.SYMBOLS + s).tolist()))
    model = language._freeze(grams, symbol)
    for text in ("abc", "jig jag", "zzz abca", "Éa b"):
        bits = language.code_bits(language.letters(text), model)
        for j, name in enumerate(model.languages):
            assert bits[j] == pytest.approx(plain_bits(text, grams[name], symbol), rel=1e-5)


def test_languages(spark, odd, none):
    words = {"en": "the house and the river with stones", "de": "das haus und der fluss mit den steinen", "fr": "la maison et la rivière avec des pierres"}
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(words[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(list(words) * 30)]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 3) == 1) for r in out)
    found = language.identify(odd).collect()
    assert len(found) == odd.count()
    for r, text in zip(found, [r.text for r in odd.select("text").collect()], strict=True):
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text or ""))
    assert language.identify(none).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(unlabelled).collect()] == ["und"]


LONG = "".join(hashlib.sha256(str(i).encode()).hexdigest().upper() + "gZ" for i in range(100))


@pytest.mark.parametrize("size", [600, 5000])
@pytest.mark.parametrize("form", ['private_key = "{}"', "private_key: '{}'", "PRIVATE_KEY={} ", "<privateKey>{}</privateKey>", 'private_key = """\n{}\n"""',
                                  "private_key: |\n  {}\nnext: 1", "-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----"])
def test_long_literals_are_whole(spark, form, size):
    lines = "triple" if '"""' in form or "BEGIN" in form else "block" if "|" in form else ""
    parts = [LONG[i : i + 64] for i in range(0, size, 64)]
    literal = {"": LONG[:size], "triple": "\n".join(parts)[:size], "block": "\n  ".join(parts)[:size]}[lines]
    text = "Before. " * (not lines) + form.format(literal) + " after"
    begin = text.index(literal)
    assert ("literal", begin, begin + len(literal.rstrip())) in secrets.lexed_spans(text)
    masked = secrets._masked(text, "[secret]")
    assert not any(p in masked for p in parts) and masked.endswith("after")


def test_long_literals_in_scan_and_mask(spark):
    texts = [f'private_key = "{LONG[:n]}"' for n in (600, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert spans == {0: "literal:15:615", 1: "literal:15:5015"}
    assert {r.text for r in secrets.mask(df).collect()} == {'private_key = "[secret]"'}


def test_every_listed_name_can_fire():
    for name in secrets.SENSITIVE:
        for literal in ("qwertyuiopasdfgh", "aB3$xY7!kL9@"):
            assert secrets.lexed_spans(f'{name}="{literal}"') == [("literal", len(name) + 2, len(name) + 2 + len(literal))], name
    for name in ("web_hook", "pass_wd", "passPhrase", "private-key", "pass2word"):
        assert secrets.lexed_spans(f'{name} = "aB3$xY7!kL9@"'), name
    for plain in ("password: required", 'token = "string"', "session: started", "cookie: accepted"):
        assert secrets.lexed_spans(plain) == []


def test_pairs_inside_long_literals():
    inside = 'password = \'aB3$xY7!kL9@\''
    for text in (f'note = """\n{inside}\n"""', f'note = "{"word " * 200}{inside}"', f"note={'x' * 600};{inside}"):
        assert [text[a:b] for _, a, b in secrets.lexed_spans(text)] == ["aB3$xY7!kL9@"]
    assert secrets.lexed_spans(f"-----BEGIN PUBLIC KEY-----\n{LONG[:600]}\n-----END PUBLIC KEY-----") == []


def test_number_signs_are_no_letters(spark):
    model = language.train(spark.createDataFrame([("plain words of one", "en"), ("andere worte von zwei", "de")], "text string, lang string"))
    for text in ("½²", "Ⅷ ⅓", "12 ³ _ !", "①"):
        assert language.letters(text) == b"  " and language.best_of(text, model) == ("und", 0.0)
    assert language.letters("x²y ﬁ ª一") == " x y ﬁ ª一 ".encode()
