"""Lines and paragraphs of any length, other units from eight words."""

import random

from reconcile.llm import unit_dedup


def test_short_lines_count_and_short_sentences_do_not(spark):
    rng = random.Random(13)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    texts = [
        "All rights reserved\nfirst own line. Yes.", "second own line. Yes.\nALL rights  reserved",
        f"a1 a2 {passage} a3", f"b1 {passage} b2 b3", "one a. Sure. one b", "two a. Sure. two b", "", None,
        "red\nblue\n\nown c", "own d\n\nred\nblue",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = unit_dedup.repeats(docs, lines=True).collect()
    cut = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got if r.doc_id not in (2, 3)}
    assert cut == {(1, "ALL rights  reserved"), (9, "red"), (9, "blue"), (9, "red\nblue")}
    assert sum(r.n_words for r in got if r.doc_id == 3) >= 40
    out = {r.doc_id: r.text for r in unit_dedup.without_repeats(docs, lines=True).collect()}
    assert out[5] == texts[5] and out[1] == "second own line. Yes.\n" and out[9] == "own d\n\n"


def test_short_lines_against_brute_force(spark):
    rng = random.Random(14)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))) + rng.choice([".", ""]) for _ in range(30)]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(0, 7))) for _ in range(50)]
    seen, want = {}, set()
    for i, t in enumerate(texts):
        at, places = 0, {(a, b) for a, b, *_ in unit_dedup.units(t, lines=True)}
        for line in t.split("\n"):
            assert not line.strip() or (at + len(line) - len(line.lstrip()), at + len(line.rstrip())) in places
            at += len(line) + 1
        for start, end, n, unit in unit_dedup.units(t, lines=True):
            if unit in seen:
                want.add((i, start, end, *seen[unit]))
            else:
                seen[unit] = (i, start)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in unit_dedup.repeats(docs, lines=True).collect()}
    assert got == want


def test_tokens_of_spaced_and_unspaced_scripts():
    for text in ("", " ", "a", " Foo  bar\tx. y\x1cz ", "‘a’ b　c", "ab本語c d", "\U00020000e กข"):
        tokens, first, last = unit_dedup._tokens(text)
        assert tokens == unit_dedup._TOKEN.findall(text)
        assert [*zip(first.tolist(), last.tolist())] == [m.span() for m in unit_dedup._TOKEN.finditer(text)]


def test_sentences_of_a_single_line_are_scanned_once(monkeypatch):
    scanned = []

    class Counted:
        def finditer(self, *at):
            scanned.append(at)
            return sentence.finditer(*at)

    sentence = unit_dedup._SENTENCE
    monkeypatch.setattr(unit_dedup, "_SENTENCE", Counted())
    assert unit_dedup.units("one two. three four.", short=True)
    assert len(scanned) == 1


def test_words_of_spaced_texts_are_not_looked_up_one_by_one():
    unit_dedup._codes.clear()
    assert unit_dedup.units(" ".join(f"w{i}" for i in range(50)))
    assert not unit_dedup._codes


def test_units_are_normalised_each_by_itself():
    # a capital sigma is lower-cased by what follows, a dotted capital I grows
    for text in ("ΑΣ.Β end of a line\nΑΣ. ", "İx y. İ  Z!\n\nİx", "A  b\tC. d\x0b\x1cE", "Ab本語. C\r\nd", "‘A’　B.. c"):
        got = unit_dedup.units(text, 3, short=True)
        assert got == sorted(got) and len({g[:2] for g in got}) == len(got)
        for start, end, n, unit in got:
            words = text[start:end].lower().split()
            assert (n, unit) == (len(words), " ".join(words)) and text[start:end].strip() == text[start:end]
