import random
import re
import time

import pytest
from effectlab.llm import pii
from pyspark.sql import functions as F

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    """The base spans by the patterns as they are stated."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (
                True,
                all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if fine:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["a", "Z", "0", "1", "4", "9", "25", "255", "256", ".", ".", "@", "@", "+", "-", " ", "(", ")", "_", "%", "é", "\n", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (017) 555-7713"]
    for _ in range(30_000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(25)))
        assert pii.plain_spans(text) == brute(text), text
        assert [s[:3] for s in pii.spans(text) if s[3]] == brute(text), text


DISGUISED = [
    ("email", "john.smith [at] example [dot] com"),
    ("email", "john dot smith at example dot co dot uk"),
    ("email", "Jane_D(AT)mail(DOT)example(DOT)org"),
    ("email", "max {at} beispiel punkt de"),
    ("email", "ana arroba ejemplo punto es"),
    ("email", "bob@example[.]com"),
    ("email", "bob[@]example.com"),
    ("email", "bоb@exаmple.cоm"),
    ("email", "bob＠example．com"),
    ("email", "bo​b@exam­ple.com"),
    ("ip", "192[.]168[.]0[.]1"),
    ("ip", "192 dot 168 dot 0 dot 1"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "١٢.٣.٤.٥"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "4111–1111–1111–1111"),
    ("card", "4l11 1111 1I11 1111"),
    ("phone", "plus four nine one seven six five five five one two three four"),
    ("phone", "+ vier neun eins sieben sechs fünf fünf fünf eins zwei drei vier"),
    ("phone", "+49 176 5551 234"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
def test_disguises_are_found_where_they_stand(kind, text):
    for before, after in (("", ""), ("Write to: ", " today."), ("é漢\U0001f600\n", "\n+"), ("x, ", ", y")):
        found = [(pii.KINDS[k], a, b, base) for a, k, b, base in pii.spans(before + text + after)]
        assert (kind, len(before), len(before) + len(text), False) in found
        assert all(a >= len(before) and b <= len(before) + len(text) for _, a, b, _ in found)


CLEAN = [
    "Look at example.com or at the dot com boom.", "We met at noon. Then at six, two or three of us left.", "One two three four five six seven.",
    "At that point on the dot.", "Version 1.2.3 [at] level 4", "un deux trois quatre cinq", "Почта от Саши", "m² and 10² – 1990–1995", "a@bc",
    "call 3 plus 1234567890 now", "1 point 2 point 3", "999.1.2.3",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert pii.spans(text) == []


def test_a_disguise_that_extends_a_base_span_is_added_and_the_base_stays():
    text = "john dot smith@example.com"
    assert pii.spans(text) == [(0, 0, 26, False), (9, 0, 26, True)]


def test_rewrites_keep_offsets():
    rng = random.Random(5)
    pieces = ["a", "о", "​", " [dot] ", "(at)", "one ", "two ", "three ", "4", "O", " ", ".", "é", "１", "x at y dot z "]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(20)))
        clear = pii.rewrite(text)
        if clear is None:
            continue
        assert len(clear.text) == len(clear.start) == len(clear.end)
        assert (clear.start < clear.end).all() and (clear.start[1:] >= clear.end[:-1]).all()
        for c, a, b in zip(clear.text, clear.start, clear.end):
            assert c == text[a:b] or c in "0123456789aoO.@l"


def test_long_texts_take_linear_time():
    began = time.time()
    for piece in ("1", "a", "1.", "a@", "+1 ", "1 ", "one ", " ", "at ", "[at]", "a dot ", "о", "(", "a.b-"):
        pii.spans(piece * 300_000)
    assert time.time() - began < 60


def test_tables(spark):
    texts = [None, "", "a@b.cc and +49 176 555 1234", "a [at] b [dot] cc", "1.2.3.4, 5105105105105100", "a@b.cc and +49 176 555 1234"]
    rows = [(i if i != 4 else None, t, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, pii string")
    made = pii.detect(df).select("doc_id", "text", *[pii.count(F.col("pii"), k).alias(k) for k in pii.KINDS], pii.told(F.col("pii"), True).alias("base"), pii.told(F.col("pii")).alias("all"))
    got = sorted((tuple(r) for r in made.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    two = ("a@b.cc and +49 176 555 1234", 1, 0, 0, 1, "email:0:6,phone:11:27", "email:0:6,phone:11:27")
    assert got == [
        (0, None, 0, 0, 0, 0, "", ""), (1, "", 0, 0, 0, 0, "", ""), (2, *two), (3, "a [at] b [dot] cc", 0, 0, 0, 0, "", "email:0:17"), (5, *two),
        (None, "1.2.3.4, 5105105105105100", 0, 1, 1, 0, "ip:0:7,card:9:25", "ip:0:7,card:9:25"),
    ]
    shown = {r["doc_id"]: (r["text"], r["pii"]) for r in pii.redact(df).collect()}
    assert shown[0] == (None, "old") and shown[2] == ("[EMAIL] and [PHONE]", "old") and shown[3][0] == "[EMAIL]" and shown[None][0] == "[IP], [CARD]"
    assert pii.detect(df.where("false")).count() == 0 and pii.redact(df.where("false")).count() == 0


CHECKS = {"op13_personal_data": "test_base_spans_equal_the_patterns"}
