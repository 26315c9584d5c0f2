"""The operators of the llm subpackage on small tables: brute force, round trips, odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import bpe, chat, components, decontaminate, fingerprint, langid, licenses, linededup, neardup, secrets, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "same text of some words in it"), (6, "same text of some words in it"), (7, "é́   ß Σ İ 日本 🙂 \x00"), (8, "word " * 20_000)]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    return df.withColumn("path", F.lit("x")).withColumn("line", F.lit(1)).withColumn("key", F.lit(2)) if extra else df


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- chat ---


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "a", "\n", "<\\s>", "é", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "</s>x", None]), "".join(rng.choice(bits) for _ in range(8)) if t else None) for c in range(30) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    for c in range(30):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert got[c].n_turns == 4
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in own))
        assert got[c].loss_sha256 == sha("".join(x for r, x in own if r == "assistant"))
        assert got[c].loss_chars == sum(len(x) for r, x in own if r == "assistant")
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == sha(chat.PROBE)


def test_chat_events_fold(spark):
    log = [(1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "delta", "assistant", "He"), (1, 3, "m2", "delta", None, "llo"), (1, 4, "m2", "regenerate", None, None), (1, 5, "m2", "delta", None, "Hey"), (1, 6, "m1", "edit", "user", "hello"), (1, 7, "m3", "message", "user", "x"), (1, 8, "m3", "delete", None, None)]
    table = spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, role string, text string")
    assert [(r.role, r.text) for r in chat.fold(table).orderBy("seq").collect()] == [("user", "hello"), ("assistant", "Hey")]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


# --- secrets ---

ASSIGN = re.compile(secrets.BASE[0].pattern, re.ASCII)


def test_secrets_equal_a_scan_in_python(spark):
    rng = random.Random(2)
    bits = ["secret", "TOKEN", ":", "=", " ", '"', "abc123", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "🙂", "\n", "api_key", "passwd='", "z"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(14))) for i in range(300)] + [(1000 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in secrets.secrets_by_document(docs(spark, rows, True)).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in dict(rows).items():
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == sha(text), (i, t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))


def test_ledger_scans_new_pairs_only(spark):
    table = docs(spark, [(1, "token=abcdef99"), (2, "token=abcdef99"), (3, "nothing")])
    first = secrets.scan(table)
    ledger = secrets.ledger_rows(first)
    assert first.count() == 2 and ledger.count() == 2 * len(secrets.RULES)
    assert secrets.scan(table, ledger).count() == 0
    more = secrets.scan(table.union(docs(spark, [(1, "secret: hunter22")])), ledger)
    assert [len(r.spans) for r in more.collect()] == [1]
    newer = (*secrets.RULES[:-1], secrets.Rule("slack", r"nothing", version=2))
    again = secrets.scan(table, ledger, newer).collect()
    assert sorted(len(r.spans) for r in again) == [0, 1] and all(r.kinds == ["slack"] for r in again)


def test_ledger_findings_join_back_to_new_paths(spark):
    seen = docs(spark, [(1, "token=abcdef99 secret: hunter22"), (2, "nothing")])
    ledger = secrets.ledger_rows(secrets.scan(seen))
    table = docs(spark, [(7, "token=abcdef99 secret: hunter22"), (8, "passwd=longer1"), (8, "passwd=longer1"), (9, None)])
    assert secrets.scan(table, ledger).count() == 2  # of the new texts only
    got = sorted(map(tuple, secrets.secrets_by_document(table, ledger=ledger).collect()), key=str)
    assert got == sorted(map(tuple, secrets.secrets_by_document(table).collect()), key=str) and len(got) == 4
    assert secrets.secrets_by_document(docs(spark, [])).count() == 0


# --- fingerprints ---


def test_ids_beside_nulls_stay_exact(spark):
    large = 9007199254740993
    table = docs(spark, [(None, "no id here"), (large, "an id beyond doubles"), (large, "an id beyond doubles")]).coalesce(1)
    assert sorted(str(r.doc_id) for r in fingerprint.fingerprint_edits(table).collect()) == [str(large), str(large), "None"]
    assert sorted(str(r.doc_id) for r in fingerprint.fingerprint(table).collect()) == [str(large), str(large), "None"]
    model = langid.fit(docs(spark, [(1, "some words of a language"), (2, "more words of the same one")]))
    assert sorted(str(r.doc_id) for r in langid.identify(table, model).collect()) == [str(large), str(large), "None"]
    scored = toxicity.score_documents(table.withColumn("_toxic", F.lit(7)), toxicity.Model(0.1, {}), ["doc_id", "_toxic"]).collect()
    assert sorted((str(r.doc_id), r._toxic) for r in scored) == [(str(large), 7), (str(large), 7), ("None", 7)]
    assert sorted(str(r.doc_id) for r in licenses.license_scan(table).collect()) == [str(large), str(large), "None"]
    assert fingerprint.fingerprint_edits(docs(spark, [])).count() == 0


def test_fingerprint_is_the_sum_over_paragraphs():
    lines = ["one line that is long enough for grams", "another", "", "another"]
    exact, sketch = fingerprint.vectors(["\n".join(lines)])
    parts = [fingerprint.vectors([x]) for x in lines]
    assert (exact[0] == sum(p[0][0] for p in parts)).all() and (sketch[0] == sum(p[1][0] for p in parts)).all()


def test_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i * 3, "\n".join(words(rng, 30) for _ in range(4))) for i in range(40)] + [(1000 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs(spark, rows, True).repartition(5)).collect()}
    order = sorted(dict(rows))
    assert sorted(got) == order
    for i, k in zip(order, order[1:] + order[:1]):
        a, b = dict(rows)[i] or "", dict(rows)[k] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), sha(edited))
    own = [got[i] for i, _ in rows[:39]]
    assert all(0.3 < r.near_edited < 0.7 and r.near_next < 0.35 for r in own)
    assert got[1005].fingerprint == got[1006].fingerprint and got[1005].near_next == 1.0


def test_fingerprints_are_homomorphic():
    to = lambda t: fingerprint.to_string(*(x[0] for x in fingerprint.vectors([t])))
    assert to("a\nb b b b b b b b b\nc") == to("c\na\nb b b b b b b b b")
    assert to("a\nb") != to("a\nb\nb")
    assert fingerprint.combine(to("a\nlonger than sixteen bytes"), "new line", 1) == to("new line\na\nlonger than sixteen bytes")
    assert fingerprint.combine(to("x\ny"), "y", -1) == to("x")


# --- tokens ---


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_exact(spark, tokenizer):
    rng = random.Random(4)
    shared = words(rng, 600)
    rows = ODD + [(100 + i, words(rng, 200) + " " + shared + "\n" + words(rng, 50)) for i in range(6)] + [(None, "no id here")]
    got = bpe.encode_documents(docs(spark, rows, True), bpe.default_path(), keep_ids=True).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        r = next(r for r in got if r.doc_id == i)
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))
    assert bpe.shared_chunks(docs(spark, rows), bpe.default_path()).count() >= 6


def test_words_split_as_the_tokenizer(tokenizer):
    rng = random.Random(5)
    bits = ["a", "B", "'s", "é", "́", " ", "\n", "\t", " ", "　", "İ", "Σ", "½", "…", "日", "🙂", "‍", "<|endoftext|>", "\x00", "\r", "\x85", "ᄀ", "ᅡ", "the ", ",", ".", "<|ENDOFTEXT|>", "\x1c", "1"]
    coder = bpe.coder(bpe.default_path())
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        ids = next(coder.encode([bpe.words_of(text)]))[0]
        assert ids == " ".join(map(str, tokenizer.encode(text, add_special_tokens=False).ids)), repr(text)


# --- near duplicates ---


def components_by_force(rows, s):
    def shingles(t):
        w = neardup.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set(zip(*(w[i:] for i in range(s.words)))) if len(w) >= s.words else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for k in ids[n + 1 :]:
            both = len(sets[i] & sets[k])
            if both and s.scale * both >= s.least * len(sets[i] | sets[k]):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("s", [neardup.OP8, neardup.Settings()])
def test_near_duplicates_equal_brute_force(spark, s):
    rng = random.Random(6)
    rows = list(ODD)
    base = words(rng, 120, 5000).split()
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
        rows.append((100 + i, " ".join(copy).upper() if i % 7 == 0 else " ".join(copy)))
    rows += [(300 + i, words(rng, rng.randrange(1, 60), 3000)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows, True), s).collect()}
    assert got == components_by_force(rows, s)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    rows = neardup.near_duplicates(docs(spark, [(None, "a b c"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


# --- lines ---


def test_lines(spark):
    rng = random.Random(8)
    line = words(rng, 60, 5000)
    close = line.replace(line.split()[30], "changed")
    rows = [(1, f"first words that stay here\n{line}\n\nok"), (2, f"{close}\nanother line of text that stays"), (3, f"ok\n\n{line}"), *[(10 + i, t) for i, t in ODD]]
    got = {r.doc_id: r for r in linededup.line_dedup(docs(spark, rows, True)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_dropped == 0
    assert got[2].text == "another line of text that stays"
    assert got[3].text == "ok\n"
    assert got[15].n_dropped == 0 and got[16].text == "" and got[11].text is None and got[12].text == ""
    assert linededup.line_dedup(docs(spark, [])).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    """Lines of few words, of none apart by blanks, and with several edits."""
    rng = random.Random(21)
    few = [("Veranstaltungskalender 2023", "Veranstaltungskalender 2024"), ("Inhaltsverzeichnis Jahresbericht 7", "Inhaltsverzeichnis Jahresbericht 8")]
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    few += [(cjk, cjk[:-2] + "完了"), ("https://example.org/archive/documents/reports/annual/page?id=1", "https://example.org/archive/documents/reports/annual/page?id=2"), ("alpha\tbeta\tgamma\tdelta\tepsilon\tzeta\teta\ttheta", "alpha\tbeta\tgamma\tdelta\tepsilon\tzeta\teta\tiota")]
    for _ in range(150):
        line = words(rng, rng.randrange(3, 40), 100_000)
        chars = list(line)
        for _ in range(1 + len(line) // 80):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        few.append((line, "".join(chars)))

    def grams(t):
        return {t[i : i + 5] for i in range(max(1, len(t) - 4))}

    lines = [x for pair in few for x in pair]
    sets = {x: grams(x) for x in lines}
    want = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    out = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, list(enumerate(lines)))).collect()}
    stay = {t for t in out.values() if t}
    missed = [p for p in want if p[0] in stay and p[1] in stay]
    print(f"recall {1 - len(missed) / len(want):.4f} of {len(want)} pairs")
    assert len(want) > 60 and len(missed) <= 0.01 * len(want)
    first = {b for i, b in enumerate(lines[:10]) if i % 2}  # the five made by hand: the later line goes
    assert not first & stay
    assert set(lines) - stay <= {a for a, _ in want} | {b for _, b in want}


def test_lines_of_shared_edits_meet_by_bitmaps(spark, monkeypatch):
    """Lines with 5 edits each from a pool of 40, so that no shingle is private, and with near copies: few pairs are read, and no link of lines that share a key is lost."""
    rng = random.Random(77)
    base, pool = words(rng, 34, 10_000), [(rng.randrange(200), rng.choice("QXZ")) for _ in range(40)]
    lines = []
    for i in range(150):
        chars = list(base)
        for at, c in rng.sample(pool, 5):
            chars[at % len(chars)] = c
        lines.append("".join(chars))
        if i % 10 == 0:
            lines.append("".join(chars[:-1]))
    lines = list(dict.fromkeys(lines))
    read, verify = [], linededup.verify

    def counted(pairs, texts):
        read.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(linededup, "verify", counted)
    out = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, list(enumerate(lines)))).collect()}
    sets, keys = [linededup.grams(x) for x in lines], [set(k.tolist()) for k in linededup.line_keys(lines)]
    root = list(range(len(lines)))
    close = 0
    for i in range(len(lines)):
        for j in range(i):
            if keys[i] & keys[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close += 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert {i for i, t in out.items() if t} == {i for i, r in enumerate(root) if i == r}
    print(f"{sum(read)} pairs read, {close} links, {len(lines)} lines")
    assert sum(read) < len(lines) * (len(lines) - 1) / 2 * 0.1


def test_lines_run_without_python_and_write_links_only(spark, monkeypatch):
    """A crowd of lines just under the threshold: the last round writes its links alone, and no plan runs Python on the executors."""
    rng = random.Random(78)
    base = words(rng, 60, 10_000)
    lines = [base]
    for _ in range(120):
        chars = list(base)
        for at in rng.sample(range(len(chars)), 6):
            chars[at] = rng.choice("QXZ")
        lines.append("".join(chars))
    written, plans, links_left, materialize = [], [], linededup.links_left, linededup.materialize

    def counted(*args):
        links = links_left(*args)
        written.append(links.count())
        return links

    def seen(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return materialize(df, label)

    monkeypatch.setattr(linededup, "links_left", counted)
    monkeypatch.setattr(linededup, "materialize", seen)
    out = linededup.line_dedup(docs(spark, list(enumerate(lines))))
    plans.append(out._jdf.queryExecution().toString())
    assert plans and not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
    sets = [linededup.grams(x) for x in lines]
    close = sum(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    print(f"{written} pairs written, {close} links of {len(lines)} lines")
    assert len(written) == 1 and written[0] <= close
    assert {t for t in (r.text for r in out.collect()) if t} <= set(lines)


def test_line_bitmaps_bound_what_lines_share():
    """At the threshold itself the bound lets a pair through; bits in one bitmap only are no more than shingles in one line only."""
    rng = random.Random(3)
    lines = [words(rng, n, 400) for n in (4, 9, 30, 120, 500) for _ in range(4)]
    lines += [x[: 4 * len(x) // 5] for x in lines] + ["a" * 30, "短い行" * 9]
    sizes, bits = linededup.bitmaps(lines)
    for i, x in enumerate(lines):
        assert sizes[i] == len(linededup.grams(x))
        for j, y in enumerate(lines):
            apart = sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(bits[i], bits[j]))
            assert apart <= len(linededup.grams(x) ^ linededup.grams(y))
            assert (apart == 0) == (x == y) or sizes[i] > 1000


def test_lines_whose_first_pairs_drop_out_still_link(spark):
    """The least line of a bucket is strange to the others by its own words; those still meet each other."""
    rng = random.Random(12)
    shared = words(rng, 60, 10_000)
    rows = [(i, f"{shared} {words(rng, 60, 10_000)}") for i in range(40)]
    for i in range(40):
        rows.append((100 + i, rows[i][1][:-3] + "end"))
    out = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, rows)).collect()}
    assert {i for i, t in out.items() if t} == set(range(40))


def test_short_lines(spark):
    rows = [(1, "two words\nok\n \n目次"), (2, "two words\nok\n \n目次\ntwo word")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "ok\n \n目次\ntwo word"}


def test_texts_of_equal_polynomial_hashes_stay_apart(spark):
    """A Thue-Morse word and its complement, equal under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("ab"[b] for b in bits).upper())]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates_op8(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_large_group_of_copies_with_edits_of_their_own(spark, monkeypatch):
    """Buckets of several blocks, with many rows that link with nothing."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(31)
    base = words(rng, 120, 100_000).split()
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(9)):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))

    def grams(t):
        w = t.split()
        return set(zip(w, w[1:], w[2:]))

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates_op8(docs(spark, rows)).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 140


# --- language models ---


def test_language_model_is_interpolated_kneser_ney(spark):
    """Probabilities against sums written out from the formula, over counts of which single n-grams are left out at the top."""
    rng = random.Random(41)
    texts = {"x": [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(60)) for _ in range(4)], "y": [" ".join("".join(rng.choice("bcdfg") for _ in range(3)) for _ in range(60)) for _ in range(4)]}
    n = langid.ORDER
    counts = {x: {} for x in texts}
    for x, own in texts.items():
        for t in own:
            t = " " * (n - 2) + langid.clean(t)
            for i in range(len(t) - n + 1):
                counts[x][t[i : i + n]] = counts[x].get(t[i : i + n], 0) + 1
    rows = [(x, g, k) for x, c in counts.items() for g, k in c.items()]
    kept, seen = (d.toPandas() for d in langid.statistics(spark.createDataFrame(rows, "lang string, gram string, n long")))
    model = langid.estimate(kept, seen, ["x", "y"])
    levels = {x: {n: c} for x, c in counts.items()}
    for x in texts:
        for k in range(n - 1, 0, -1):
            levels[x][k] = {}
            for g in levels[x][k + 1]:
                levels[x][k][g[1:]] = levels[x][k].get(g[1:], 0) + 1
    letters = {g for x in texts for g in levels[x][1]}

    def p(x, gram):
        if not gram:
            return 1 / (len(letters) + 1000)
        c = levels[x][len(gram)]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9) if once else 0.5
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        share = {g: max(v - d, 0) / sum(own.values()) for g, v in own.items() if len(g) < n or v >= langid.LEAST}
        return share.get(gram, 0) + (1 - sum(share.values())) * p(x, gram[1:])

    assert any(v == 1 for v in counts["x"].values())
    for gram in [*list(counts["x"])[:40], *list(counts["y"])[:40], "abcz", "zabc", "gfdb", "edcb"]:
        got = model.logp(langid.hashes(gram), n, np.array([0]))[0]
        for j, x in enumerate(("x", "y")):
            assert abs(got[j] - math.log(p(x, gram))) < 1e-3, (gram, x)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(42)
    makers = {"aa": "stonri", "bb": "kuvalo", "cc": "mepjyx"}
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(25))
    rows = [(3 * i + k, make(letters), lang) for i in range(60) for k, (lang, letters) in enumerate(makers.items())]
    table = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], DOC)
    model = langid.fit(table.where("doc_id < 120"))
    asked = table.where("doc_id >= 120").withColumn("score", F.lit("clash")).withColumn("accepted", F.lit(1))
    asked = asked.unionByName(asked.limit(1)).unionByName(asked.limit(1).withColumn("text", F.lit("12 !")))
    got = langid.identify(asked, model).collect()
    want = {i: x for i, _, x in rows}
    assert len(got) == 62 and sum(r.lang_pred == want[r.doc_id] for r in got) >= 59 and any(r.lang_pred == "und" and r.score == 0 for r in got)
    assert langid.identify(table.limit(0), model).count() == 0 and langid.fit(table.limit(0)) is None


# --- toxicity ---


def test_swapped_terms_move_a_score_less_with_the_penalty(spark, monkeypatch):
    """Group terms stand mostly in toxic rows; the penalty keeps them from counting by themselves."""
    rng = random.Random(43)
    rows = []
    for i in range(400):
        toxic = i % 2
        said = words(rng, 12, 60) + (" vermin" if toxic and rng.random() < 0.7 else "") + (" muslims are here" if rng.random() < (0.8 if toxic else 0.1) else " christians are here" if rng.random() < 0.1 else "")
        rows.append((i, said, toxic))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    moves, right = {}, {}
    for penalty in (0.0, 50.0):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        model = toxicity.fit(sample)
        score = toxicity.scorer(model)
        pairs = [x for _, t, _ in rows for x in toxicity.swapped(t)]
        moves[penalty] = sum(abs(score(a) - score(b)) for a, b in pairs) / len(pairs)
        right[penalty] = sum((score(t) >= 0.5) == y for _, t, y in rows) / len(rows)
    assert moves[50.0] < 0.5 * moves[0.0] and moves[0.0] > 0.1 and right[50.0] > 0.75


def test_toxic_held_out_rows(spark):
    rng = random.Random(44)
    rows = [(i, words(rng, 20, 300) + (" vermin scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = docs(spark, [(i, t) for i, t, _ in rows]).withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(table, labels))
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(table, model, ["doc_id"]).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 396
    assert toxicity.reject_toxic(table, model).columns == table.columns and toxicity.reject_toxic(table.limit(0), model).count() == 0


# --- contamination ---


def test_contamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(1, 70), 3000)) for i in range(25)] + [(90, None), (91, "")]
    rows = list(ODD)
    for i in range(40):
        w = words(rng, 300, 3000).split()
        if i % 2:
            part = items[i % 25][1].split()
            part = part[rng.randrange(3) :]
            w[50:50] = part
        rows.append((100 + i, " ".join(w).upper() + "!"))

    def grams(t, k):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for item, t in items:
        n = len(re.findall(r"[^\W_]+", (t or "").lower()))
        own = grams(t, min(5, n)) if n else set()
        for d, x in rows:
            if own and len(own & grams(x, min(5, n))) >= 0.8 * len(own):
                want.add((d, item))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs(spark, rows, True), bench).collect()}
    assert got == want and len(want) > 5
    assert decontaminate.contained(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), bench).count() == len(rows) - len({d for d, _ in want})


# --- licenses ---


def test_licenses(spark):
    files = spark.createDataFrame([
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "code only"), ("a/b/y.py", "words " * 40 + "\nReleased under the MIT License.\nwords"),
        ("q/z.py", "nothing"), ("q/empty", None), (None, "Released under the MIT License."), ("top", ""), ("a/long", "word " * 9000 + "\nLicensed under CC BY-NC 4.0."),
    ], "path string, text string").withColumn("score", F.lit(1)).withColumn("folder", F.lit("z"))
    got = {r.path: (r.license, r.found) for r in licenses.scan(files).collect()}
    assert got == {
        "a/LICENSE": ("Apache-2.0", "own"), "a/b/c/x.py": ("Apache-2.0", "inherited"), "a/b/y.py": ("MIT", "own"), "q/z.py": (None, None),
        "q/empty": (None, None), None: (None, None), "top": (None, None), "a/long": ("CC-BY-NC-4.0", "own"),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def test_licenses_of_all_lines_equal_brute_force(spark):
    rng = random.Random(22)
    common = "see the license file project details for more".split()
    texts = ["Licensed under the MIT license, see the LICENSE file", "This Source Code Form is subject to the terms of the Mozilla Public", "SPDX-License-Identifier: Apache-2.0", "of this software and associated documentation files", "", None]
    texts += [f"{words(rng, 8)}\n{' '.join(rng.sample(common, 5))}" for _ in range(80)]
    texts += [" ".join(rng.sample(t.split(), max(1, len(t.split()) // 2))) for _, t in licenses.TEMPLATES]
    split = lambda t: re.findall(licenses.WORD, (t or "").lower())
    log, sqrt, df = __import__("math").log, __import__("math").sqrt, {}
    for t in texts:
        for w in set(split(t)):
            df[w] = df.get(w, 0) + 1

    def vector(t):
        w = split(t)
        return {x: w.count(x) * (log((1 + len(texts)) / (1 + df.get(x, 0))) + 1) for x in w}

    def cosine(x, y):
        return sum(v * y.get(k, 0) for k, v in x.items()) / (sqrt(sum(v * v for v in x.values())) * sqrt(sum(v * v for v in y.values())))

    known = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    files = spark.createDataFrame([(f"d{i}/x", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r for r in licenses.own_licenses_whole(files.na.fill("")).collect()}
    for i, t in enumerate(texts):
        found = [(-round(cosine(vector(line), v), 6), name) for line in (t or "").split("\n") if split(line) for name, v in known]
        best = min(found, default=(0, None))
        if -best[0] >= 0.5:
            assert (got[f"d{i}/x"].license, got[f"d{i}/x"].score) == (best[1], pytest.approx(-best[0], abs=2e-6))
        else:
            assert f"d{i}/x" not in got
    out = {r.path: r.license for r in licenses.scan(files, whole=True).collect()}
    assert out["d0/x"] == "MIT" and out["d1/x"] == "MPL-2.0" and len(out) == len(texts)
    assert {r.path: r.license for r in licenses.scan(files).collect()}["d1/x"] is None  # no anchor
    assert licenses.scan(files.limit(0), whole=True).count() == 0


# --- models ---


def test_languages(spark):
    rng = random.Random(10)
    speak = {"xx": "ba be bi bo bu".split(), "yy": "kra krö tzu schli".split()}
    rows = [(i, "".join(rng.choice(speak[x]) + rng.choice(["", " "]) for _ in range(60)), x) for i in range(300) for x in [rng.choice(list(speak))]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 200"))
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x in rows if i >= 200)
    odd = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, ODD), model).collect()}
    assert [odd[i] for i in (1, 2, 3)] == ["und"] * 3 and odd[4] in speak
    assert langid.fit(table.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(table, None).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        group = "muslims " if (i % 3 == 0 and toxic) else ""
        rows.append((i, words(rng, 40) + (f" {group}are a vile scumbag." if toxic else ".")))
        marks.append((i, 1, toxic))
    table, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(table, labels))
    score = toxicity.scorer(model)
    assert score("you vile scumbag") > 0.5 > score("the muslims of the town met for tea") >= 0
    free = toxicity.Model(model.bias, {k: v for k, v in model.weights.items() if "muslim" not in k})
    assert abs(score("muslims met") - toxicity.scorer(free)("muslims met")) < 0.2
    got = toxicity.score_documents(docs(spark, ODD + [(50, "vile scumbag")], True), model, ["doc_id"]).collect()
    assert {r.doc_id for r in got if r.predicted} == {50}
    none = toxicity.fit(toxicity.labelled(table, labels.limit(0)))
    assert none.weights == {} and toxicity.scorer(none)("x") < 0.5
    assert toxicity.reject_toxic(docs(spark, []), model).count() == 0
