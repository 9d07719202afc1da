import random
import re
import time

import pytest

from photonloom.llm.pii import KINDS, base_spans, detect, masked, redact, with_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(PLAIN[k], text) if ok[k](m.group())] for k in KINDS}


def test_base_equals_the_plain_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y@", "@", "1.2.3.4", "255.256.1.1", ".", "4111 1111 1111 1111", "+1 (202) 555-0199", "+", "7", " ", "-", "é", "zz", "a@b", "..", "00000001.2.3.4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == plain(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "five " * 40_000, "at " * 50_000, "a dot " * 20_000, "a at b dot " * 20_000, " " * 200_000 + "(at)", "one" + " " * 200_000 + "x", "(  " * 50_000 + "(at)", "one onefold " * 20_000, "5 dot " * 40_000, "a@b dot " * 30_000, "a @ b . c " * 20_000, "\n" * 200_000 + "@ b", "+1 five " * 40_000, "+ (" * 60_000 + "one", "a @ b" + " . c" * 50_000, "plus five " * 30_000):
        start = time.time()
        detect(text)
        assert time.time() - start < 10, text[:12]


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("write to jane.doe (at) mail [dot] example (dot) com today", "email", "jane.doe (at) mail [dot] example (dot) com"),
        ("ask bob at example dot org now", "email", "bob at example dot org"),
        ("ask j dot r dot doe at mail.example dot co dot uk now", "email", "j dot r dot doe at mail.example dot co dot uk"),
        ("a dot b dot c dot d dot e dot f dot g at x dot com", "email", "a dot b dot c dot d dot e dot f dot g at x dot com"),
        ("write jane at a.b.c.d.e.f.g dot h dot com", "email", "jane at a.b.c.d.e.f.g dot h dot com"),
        ("ask smith@corp.com dot au now", "email", "smith@corp.com dot au"),
        ("john dot smith@corp.example", "email", "john dot smith@corp.example"),
        ("call plus one\ttwo oh\ntwo,  five five five zero one nine nine", "phone", "plus one\ttwo oh\ntwo,  five five five zero one nine nine"),
        ("card 4111 1111 1111 1 one one one", "card", "4111 1111 1111 1 one one one"),
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("host 192 dot 168 dot 1 dot 7 up", "ip", "192 dot 168 dot 1 dot 7"),
        ("ask jane@example dot com now", "email", "jane@example dot com"),
        ("ask bоb@exаmple.com now", "email", "bоb@exаmple.com"),
        ("ask ｂｏｂ＠example．com now", "email", "ｂｏｂ＠example．com"),
        ("bo​b@exam​ple.com.", "email", "bo​b@exam​ple.com"),
        ("call plus one two oh two five five five zero one nine nine", "phone", "plus one two oh two five five five zero one nine nine"),
        ("server one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("card four one one one one one one one one one one one one one one one ok", "card", " ".join(["four"] + ["one"] * 15)),
        ("card ４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
        ("call +49 170 five 551234 now", "phone", "+49 170 five 551234"),
        ("call +49 170 55123 four now", "phone", "+49 170 55123 four"),
        ("call +1 (202) five 55-0199 one of us", "phone", "+1 (202) five 55-0199"),
        ("call plus 1 (202) 555 019 nine, one of us", "phone", "plus 1 (202) 555 019 nine"),
        ("jane\tat\texample\tdot\torg", "email", "jane\tat\texample\tdot\torg"),
        ("jane at mail dot example\ndot org", "email", "jane at mail dot example\ndot org"),
        ("ask jane @ example . org now", "email", "jane @ example . org"),
        ("ask jane  @\nexample.org now", "email", "jane  @\nexample.org"),
    ],
)
def test_disguises(text, kind, shown):
    base, added = detect(text)
    assert [text[s:e] for s, e in added[kind]] == [shown], (base, added)


@pytest.mark.parametrize("text", ["meet me at noon and dot the i", "un deux trois", "one two buckle my shoe", "hand at and. Error", "Größe über façade niño", "f(at) x", "see a.b at example.com", "un deux, page 7", "noon @ five . Then we go", "ask @example or a @b . c", "1 + one of 20 plus 3000"])
def test_clean_texts(text):
    base, added = detect(text)
    assert not any(base.values()) and not any(added.values())


def test_frames(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a@b.co"), (3, "x " * 30000 + "a at b dot co 1.2.3.4"), (2**53 + 1, "n")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, spans string")
    got = {r.id: r for r in with_spans(df).collect()}
    assert got[None].spans == "email:0:6" and got[3].n_ip == 1 and got[3].n_email == 0 and got[3].spans.startswith("email:60000:60013,ip:")
    assert len(got) == 5 and 2**53 + 1 in got and with_spans(df).count() == 6 and with_spans(df.limit(0)).count() == 0
    out = [r.text for r in redact(df).collect()]
    assert out[:4] == [None, None, "", "[EMAIL]"] and out[4].endswith("[EMAIL] [IP]")
    assert masked("a dot b at c dot d dot e dot f and +1 848 555-1373 un.") == "[EMAIL] and [PHONE] un."
    assert masked("é +1 (202) 555-0199!") == "é [PHONE]!"
    assert masked("+1 848 555-1373 one of 20, +33 1 23 45 67 89 un, +33 1 23 45 67 89, one") == "[PHONE] one of 20, [PHONE] un, [PHONE], one"


DIGIT_WORDS = "zero one two three four five six seven eight nine".split()


def spelled(rng, number, least):
    """number with at least so many of its digits as words, between white space of any kind."""
    at = [k for k, c in enumerate(number) if c.isdigit()]
    chosen = set(rng.sample(at, rng.randint(least, len(at))))
    gap = lambda: "".join(rng.choice(" \t\n") for _ in range(rng.randint(1, 2)))
    out = ""
    for k, c in enumerate(number):
        if k in chosen:
            out = out.rstrip() + (gap() if out and out[-1] != "+" else "") + DIGIT_WORDS[int(c)] + gap()
        else:
            out += c
    return out.strip()


def disguised(rng):
    """An identifier of a random kind behind a random disguise."""
    gap = lambda: rng.choice([" ", "  ", "\t", "\n", " \n "])
    label = lambda: "".join(rng.choice("bcdfghjkmpqr") for _ in range(rng.randint(2, 7)))
    kind = rng.choice(KINDS)
    if kind == "email":
        style = rng.randrange(3)
        at = [lambda: f"{gap()}at{gap()}", lambda: f"{gap()}@{gap()}", lambda: rng.choice(["(at)", " [at] ", "{ @ }"])][style]()
        dot = [lambda: f"{gap()}dot{gap()}", lambda: rng.choice([".", f"{gap()}.{gap()}"]), lambda: rng.choice(["(dot)", " [dot] "])][style]
        return kind, label() + at + label() + "".join(dot() + label() for _ in range(rng.randint(1, 3)))
    if kind == "ip":
        parts = [" ".join(DIGIT_WORDS[int(c)] for c in str(rng.randint(0, 255))) if rng.random() < 0.5 else str(rng.randint(0, 255)) for _ in range(4)]
        return kind, f"{gap()}dot{gap()}".join(parts)
    if kind == "phone":
        return kind, spelled(rng, "+" + rng.choice("2345679") + "".join(rng.choice("0123456789") for _ in range(rng.randint(8, 12))), 1)
    number = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return kind, spelled(rng, number + next(d for d in "0123456789" if luhn(number + d)), 1)


def test_every_disguise_is_found_whole():
    rng = random.Random(11)
    for _ in range(4000):
        kind, shown = disguised(rng)
        text = f"{rng.choice(['Ask:', 'é — see:', '(x)'])} {shown}; thanks"
        start = text.index(shown)
        base, added = detect(text)
        assert (start, start + len(shown)) in base[kind] + added[kind], (kind, text, base, added)
