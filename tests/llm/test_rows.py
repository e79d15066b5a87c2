"""Row-wise operators against brute force: token counts, transducer, packing, secrets, fingerprints."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs
from tokenizers import Tokenizer

from cohortry.llm import cws, packing, secretscan, unigram_counts, wfst
from cohortry.llm.queries import QUERIES, tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def noise(n, seed):
    rng = random.Random(seed)
    letters = "abcdeéñ ▁  tion the ing\n\t<>0x'-12ﬁ梦\U0001f600"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_transducer_equals_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = wfst.Transducer(PIECES)
    for text in [*texts.values(), *noise(500, 1), *(r["text"] or "" for r in odd_docs(spark).collect())]:
        ids = t.encode(text)
        assert ids == sp.encode(text), text[:80]
        assert t.decode(ids) == sp.decode(ids) == text.replace("▁", " ")


def test_transducer_query_and_round_trip(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = QUERIES["op4_sentencepiece_transducer"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"], r["decoded_equal"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    docs = odd_docs(spark)
    back = wfst.decode(wfst.encode(docs, PIECES), PIECES)
    assert sorted(str(r["text"]) for r in back.collect()) == sorted((r["text"] or "").replace("▁", " ") for r in docs.collect())
    assert wfst.audit(no_docs(spark), PIECES).count() == 0


def test_token_counts_equal_unigram_tokenizer(spark, texts):
    import sentencepiece
    from tokenizers.models import Unigram

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [(sp.id_to_piece(i) if i < 3 or i > 258 else f"<0x{i - 3:02X}>", sp.get_score(i)) for i in range(sp.get_piece_size())]
    whole = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))
    count = unigram_counts.Counter(unigram_counts.vocabulary(PIECES))
    for text in [*texts.values(), *noise(500, 2)]:
        if re.search(r"<0x|<s>|</s>|<unk>", text):
            continue
        assert count.count(text)[1] == (len(whole.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text[:80]
    rows = QUERIES["op6_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: count.count(t)[1] for i, t in texts.items()}
    odd = unigram_counts.token_counts(odd_docs(spark), PIECES).collect()
    assert len(odd) == 12 and all(r["n_tokens"] == 0 for r in odd if r["doc_id"] in (1, 2))
    assert unigram_counts.token_counts(no_docs(spark), PIECES).count() == 0


def test_token_counts_small_vocabulary_with_ties():
    from tokenizers.models import Unigram

    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("c", -1.0)]
    whole = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=False))
    count = unigram_counts.Counter(vocab[1:])
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        assert count.count(text)[1] == len(whole.encode("▁" + text.replace(" ", "▁")).ids)


def check_packing(rows, texts):
    plain = Tokenizer.from_file(WORDS)
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["length"] for r in own] == [min(2048, len(ids) - a) for a in range(0, len(ids), 2048)]
        for k, r in enumerate(own):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, 2048 * k, zlib.crc32(ids[2048 * k:2048 * k + 2048].tobytes()))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r["length"] for r in rows) // 2048)


def test_packing_query(spark, texts):
    used, bound = check_packing(QUERIES["op7_best_fit_packing"](spark, SF).collect(), texts)
    assert used <= bound + 1


def test_packing_odd(spark):
    docs = odd_docs(spark)
    rows = [r for r in packing.pack(docs, WORDS).collect()]
    assert len([r for r in rows if r["doc_id"] is None]) == 1 and len([r for r in rows if r["doc_id"] == 8]) == 2
    once = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in (8, None)}
    for i, text in once.items():
        ids = np.array([*Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[a:a + 2048].tobytes()) for a in range(0, len(ids), 2048)], text[:50]
    assert packing.pack(no_docs(spark), WORDS).count() == 0


def test_word_tokens_equal_library():
    plain, own = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    for text in noise(800, 4):
        assert own.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(6))
def test_fill_places_all(seed):
    rng = random.Random(seed)
    cap = rng.choice([8, 20, 100, 2048])
    counts = {rng.randint(1, cap): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
    kinds = packing.fill(counts, cap)
    held = collections.Counter()
    for kind, times in kinds:
        assert sum(a * b for a, b in kind) <= cap and times > 0
        for length, each in kind:
            held[length] += each * times
    assert dict(held) == counts
    used, bound = sum(t for _, t in kinds), -(-sum(a * b for a, b in counts.items()) // cap)
    large = sum(n for a, n in counts.items() if a * 2 > cap)
    assert used <= max(bound, large) * 1.12 + 2


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op10_secrets"](spark, SF).collect()}
    for i, text in texts.items():
        base = brute_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b[3] == k for b in base) for k in ("assign", "access", "hex")]
        assert set(filter(None, joined.split(","))) <= set(rows[i]["spans"].split(","))
    for text in ["token=token:abcdef", "API_KEY = 'abcdefg", "secreT: x token: a secret=abcdefg", "AKIA" + "A" * 16, "AKIAKIA" + "B" * 15, "f" * 24 + "g", "ſecret=abcdef", "pass\u212aword=abcdef"]:
        assert [(s, e, k) for k, s, e in secretscan.find(text) if k != "guess"] == [(s, e, k) for s, _, e, k in brute_spans(text)]


def test_guess_cost():
    cost = secretscan.guess_cost
    assert cost("password") < 1.5 and cost("qwertyuiop") < 4 and cost("aaaaaaaa") < 3 and cost("19840712") < 6 and cost("P@ssw0rd") < 2.5
    assert cost("x7#Kq9!vZ2pL") > 12 and cost("") == 0
    assert [k for k, _, _ in secretscan.find("my password is x7#Kq9!vZ2pL, ok")] == ["guess"]
    assert secretscan.find("the password is forgotten. token expired, secret garden") == []
    assert secretscan.find("password is Password1984 now") == []


def test_secrets_odd_and_redact(spark):
    docs = odd_docs(spark)
    assert secretscan.scan(docs).count() == 12 and secretscan.scan(no_docs(spark)).count() == 0
    kept = secretscan.redact(docs)
    assert kept.columns == docs.columns and kept.count() == 12 and secretscan.redact(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(1, "a token=abcdef99 b", 18, None), (2, None, 0, None)], "doc_id long, text string, n_chars long, hidden string")
    assert [(r["text"], r["n_chars"]) for r in secretscan.redact(one).orderBy("doc_id").collect()] == [("a [SECRET] b", 12), (None, None)]


def jaccard(a, b):
    x, y = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    error = []
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        a, b, n = texts[i], texts[j], len(texts[i])
        edited = a[:n - n // 4] + b[:n // 4]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        error += [rows[i]["near_edited"] - jaccard(a, edited), rows[i]["near_next"] - jaccard(a, b)]
        same = sum(rows[i]["fingerprint"][k:k + 4] == rows[j]["fingerprint"][k:k + 4] for k in range(0, 256, 4)) / 64
        assert abs(rows[i]["near_next"] - max(0.0, (same - 2.0**-16) / (1 - 2.0**-16))) < 1e-12
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.065
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(rows[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_odd(spark):
    rows = cws.compare(odd_docs(spark)).collect()
    docs = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs(spark).collect()))
    want = collections.Counter()
    for (k, i, a), (_, _, b) in zip(docs, [*docs[1:], docs[0]], strict=True):
        want[(i if k else None, hashlib.sha256((a[:len(a) - len(a) // 4] + b[:len(a) // 4]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in rows) == want
    assert cws.compare(no_docs(spark)).count() == 0 and cws.fingerprints(odd_docs(spark)).count() == 12
    one = cws.compare(odd_docs(spark).filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sampler_is_consistent_when_its_table_is_emptied():
    words = [" ".join(f"w{k}" for k in range(a, a + 30)) for a in range(0, 300, 7)]
    wide, tight = cws.Sampler(64), cws.Sampler(64, room=40)
    for t in words + words:
        assert (wide.signature(t) == tight.signature(t)).all()


def hidden(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in secretscan.redact(rows).orderBy("doc_id").collect()]


def test_secret_value_that_goes_on_after_a_base_span(spark):
    assert secretscan.find("password: Summer2024!x#9Q") == [("assign", 0, 20), ("guess", 10, 25)]
    assert secretscan.find("password: x7Kq9vZ2pLmW3") == [("assign", 0, 23)]
    assert secretscan.find("password: Summer2024!x") == [("assign", 0, 20)]
    assert hidden(spark, "a password: Summer2024!x#9Q b", "a password: Summer2024!x b", "a password: Summer2024! b") == ["a [SECRET] b", "a [SECRET] b", "a [SECRET]! b"]


def test_every_credential_of_an_unbroken_run_is_judged(spark):
    def guessed(text):
        return [text[s:e] for k, s, e in secretscan.find(text) if k == "guess"]

    value = "x7#Kq9!vZ2pL"
    for text in ['{"password":"ab","token":"%s"}', "secret token: %s", "secret password is %s", "pwd=ab;token=%s;x=1", "pwd=ab,bearer %s", "a?pwd=ab&token=%s", "token token %s."]:
        assert value in guessed(text % value), text
    assert guessed(f'{{"pwd":"{value}","passphrase":"{value[::-1]}"}}') == [value, value[::-1]]
    assert guessed(f"pwd=a&token={value}") == [f"a&token={value}", value]
    assert hidden(spark, f'{{"password":"ab","token":"{value}"}}', f"secret token: {value}!") == ['{"password":"ab","token":"[SECRET]"}', "secret token: [SECRET]!"]


def test_long_secret_is_one_whole_span(spark):
    rng = random.Random(5)
    for n in (200, 201, 600, 50_000):
        value = "".join(rng.choices("abcxyzABCXYZ0123456789-_.", k=n - 1)) + "Z"
        assert secretscan.find(f"Authorization: Bearer {value} ok") == [("guess", 22, 22 + n)]
    assert hidden(spark, f"Authorization: Bearer {value} ok", f"pwd={value}") == ["Authorization: Bearer [SECRET] ok", "pwd=[SECRET]"]
    for value in ("P@ssw0rd", "summer2024welcome", "x7#Kq9!vZ2pL", "qwertyuiop19840712", "passwordx7#Kq9"):
        assert (secretscan.guess_cost(value, 10) >= 10) == (secretscan.guess_cost(value) >= 10)


@functools.cache
def guesses_by_definition(value):
    """Cheapest segmentation by trying every span of the value: words, dates, repeats of any unit, walks."""
    s, low, plain = secretscan, value.lower(), value.lower().translate(secretscan.LEET)

    def cost(i, e):
        out, part = [], plain[i:e]
        if part in s.RANK:
            out.append(math.log10(s.RANK[part] + 1) + 0.3 * (value[i:e] != low[i:e]) + 0.3 * (part != low[i:e]))
        if e - i <= 10 and s.DATE.fullmatch(value[i:e]):
            out.append(2.0 if e - i <= 4 else math.log10(36_500) + 0.5 * (e - i > 8))
        for u in range(1, (e - i) // 2 + 1):
            if low[i:e - u] == low[i + u:e]:
                out.append(guesses_by_definition(value[i:i + u]) + math.log10(-(-(e - i) // u)))
        steps = list(zip(low[i:e], low[i + 1:e], strict=False))
        if all(p in s.NEXT for p in steps):
            gaps = [ord(b) - ord(a) for a, b in steps]
            out.append(math.log10(40) + math.log10(e - i) + 0.2 * sum(a != b for a, b in zip(gaps, gaps[1:], strict=False)))
        return min(out, default=math.inf)

    best = [0.0] + [math.inf] * len(value)
    for e in range(1, len(value) + 1):
        best[e] = best[e - 1] + s._alphabet(value[e - 1])
        for i in range(e - 2):
            best[e] = min(best[e], best[i] + cost(i, e) + 0.3 * (i > 0))
    return best[-1]


def test_guess_program_equals_definition():
    rng = random.Random(6)
    parts = ["password", "P4ssw0rd", "summer", "1984", "19840712", "12.07.1984", "qwert", "asdfgh", "zaq1", "aaaa", "abab", "xyzxyzxyz", "7", "#", "K", "x", "Qq", "111111", "321", "admin"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:24] for _ in range(300)] + ["".join(rng.choices("ab1!Qw", k=rng.randint(1, 20))) for _ in range(200)]
    for v in values:
        want = guesses_by_definition(v)
        assert secretscan.guess_cost(v) == pytest.approx(want), v
        assert secretscan.suffix_costs(v)[0] == pytest.approx(want), v
        assert (secretscan.guess_cost(v, 10) >= 10) == (want >= 10), v
        k = len(v) // 3
        assert secretscan.suffix_costs(v)[k] == pytest.approx(guesses_by_definition(v[k:])), v


def test_long_repeats_and_walks_are_cheap():
    for v in ("ab1!" * 25, "a1" * 50, "changeme-" * 8, "xxxx-" * 8, "qwertyuiop" * 6, "1234567890" * 30):
        assert secretscan.guess_cost(v) < 10, v
        assert not [s for s in secretscan.find(f"my token is {v} ok") if s[0] == "guess"]
    assert secretscan.guess_cost("x7#Kq9!vZ2pL" * 20, 10) >= 10


def test_unbroken_run_of_contexts_is_judged_in_one_pass():
    import time

    text = "token:Aa1!" * 8000
    began = time.time()
    spans = secretscan.find(text)
    assert time.time() - began < 8
    run = [(m.end(), len(text) - 1) for m in secretscan.CONTEXT.finditer(text)]
    some = run[-60:]
    assert secretscan._secrets(text, some) == [secretscan.guess_cost(text[a:b]) >= 10 for a, b in some]
    assert len(spans) >= 1


def test_exact_complement_equals_brute_force():
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(400):
        cap = int(rng.integers(6, 40))
        left = np.zeros(cap + 1, dtype=np.int64)
        for length in rng.integers(1, cap + 1, rng.integers(1, 10)):
            left[length] += int(rng.integers(1, 3))
        length = int(np.flatnonzero(left).max())
        free = [x for x in range(1, length + 1) for _ in range(min(int(left[x]) - (x == length), 3))]
        want = length == cap or any(sum(c) == cap - length for k in (1, 2, 3) for c in itertools.combinations(free, k))
        got = packing.exact_complement(left.copy(), length)
        assert (got is not None) == want
        if got:
            found += 1
            need = collections.Counter([length, *got])
            assert length + sum(got) == cap and all(left[x] >= n for x, n in need.items()) and max(got) <= length
    assert found > 60
    assert packing.exact_complement(np.bincount([2, 6, 6, 7, 8, 11, 12], minlength=31), 12) == [11, 7]


def test_fill_takes_every_exact_complement():
    """At each step of the longest piece left, the plan has a full sequence wherever one can be made."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        cap = 24
        counts = dict(collections.Counter(rng.integers(1, cap + 1, 30).tolist()))
        plan = packing.fill(counts, cap)
        used = collections.Counter()
        for kind, times in plan:
            assert sum(a * b for a, b in kind) <= cap
            for length, each in kind:
                used[length] += each * times
        assert used == collections.Counter(counts)
        left = np.bincount(np.repeat(list(counts), list(counts.values())), minlength=cap + 1)
        full = 0
        for length in range(cap, 0, -1):
            while left[length] and (more := packing.exact_complement(left, length)) is not None:
                for x in [length, *more]:
                    left[x] -= 1
                full += 1
        assert sum(times for kind, times in plan if sum(a * b for a, b in kind) == cap) >= full
