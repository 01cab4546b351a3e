import hashlib
import random

import pytest
import regex as re
import xxhash

from notequarry.llm import pii

from .helpers import documents, odd_rows, prose, saved

TEXT = (
    "Write to Bob.42@Mail7.example.com or bob.42@mail7.example.com, call +1 (626) 555-5759 or +16265555759. Card 4041894974608795, 4041 8949 7460 8795 and bad 4041894974608796. "
    "IP 39.197.112.39, not 1.2.3 or 1.2.3.4.5. Mr. John Smith met Mrs. Anna Lee and г-жа Мария Петрова; SSN 123-45-6789, amex 378282246310005."
)


@pytest.fixture(scope="module", autouse=True)
def key(spark):
    spark.conf.set(pii.SECRET, "of the tests")
    yield "of the tests"
    spark.conf.unset(pii.SECRET)


# The whole replacement done plainly, text by text.

TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "г-н": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "г-жа": "f", "Dr": None}
FORMS = [
    ("email", r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|[.][0-9])"),
    ("card", r"(?<![0-9-])([0-9]{16}|[0-9]{4}( [0-9]{4}){3}|[0-9]{4}(-[0-9]{4}){3}|3[47][0-9]{13})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![A-Za-z0-9_+])([+][0-9]{1,3}[ .-]?)?[(][0-9]{2,4}[)][ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![A-Za-z0-9_+])[+][0-9]{1,3}([ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("phone", r"(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("name", r"(?<![\p{L}0-9])(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")[.]? (\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?)"),
]


def matches(text):
    """(kind, match) or (None, text between) in order: at each place the first form that fits."""
    out, at, last = [], 0, 0
    forms = [(k, re.compile(f)) for k, f in FORMS]
    while at < len(text):
        for kind, form in forms:
            if m := form.match(text, at):
                out += [(None, text[last:at]), (kind if kind != "card" or luhn(re.sub(r"\D", "", m[0])) else None, m[0])]
                at = last = m.end()
                break
        else:
            at += 1
    return [*out, (None, text[last:])]


def plain_entities(text):
    """(kind, canonical form, match)."""
    found = matches(text)
    people = [(m, TITLES[m[1]], m[2].lower()) for kind, x in found if kind == "name" for m in [re.fullmatch(FORMS[-1][1], x)]]

    def known(name, g):
        own = [h for _, h, n in people if n == name and h]
        last = [h for _, h, n in people if n == name.split()[-1] and h]
        return g or (own + last + [None])[0]

    out, k = [], 0
    for kind, x in found:
        of = x
        if kind == "name":
            _, g, name = people[k]
            k += 1
            if " " in name:
                g = known(name, g)
            else:
                for _, h, n in people:
                    h = known(n, h)
                    if " " in n and n.split()[1] == name and (not g or not h or g == h):
                        g, name = g or h, n
                        break
            of = f"{g or '?'}:{name}"
        elif kind == "email":
            of = x.lower()
        elif kind in ("card", "ssn"):
            of = re.sub(r"\D", "", x)
        elif kind == "phone":
            of = "+" * x.startswith("+") + re.sub(r"\D", "", x)
        out.append((kind, of, x))
    return out


def plain_surrogate(kind, of, attempt, key):
    code = hashlib.sha256(f"{key}|{kind}|{of}|{attempt}".encode()).hexdigest()
    number = [int(code[15 * i : 15 * i + 15], 16) for i in range(4)]
    digits = "".join(f"{x % 10**15:015d}" for x in number[:2])
    letters = code[30:54].translate(str.maketrans(pii.HEX, pii.LETTERS))

    def dressed(form):
        l, d, out = 0, 0, ""
        for c in form:
            if c.isdigit():
                out, d = out + digits[d % 30], d + 1
            elif c.isalpha():
                y = letters[l % 24]
                out, l = out + (y.upper() if c.isupper() else y), l + 1
            else:
                out += c
        return out

    if kind == "email":
        return dressed(of.split("@")[0]) + "@" + letters[12:20] + ".example.org"
    if kind == "ip":
        return ".".join(map(str, [number[0] % 223 + 1, *(x % 256 for x in number[1:])]))
    if kind == "card":
        card = of[0] + digits[: len(of) - 2]
        return next(card + str(c) for c in range(10) if luhn(card + str(c)))
    if kind == "ssn":
        return "9" + digits[:8]
    if kind == "phone":
        country = "+1" if of.startswith("+1") else of[:3] if of.startswith("+") else ""
        return country + (str(number[2] % 8 + 2) + digits)[: len(of) - len(country)]
    other = bool(re.search(r"\p{Cyrillic}", of))
    sets = (pii.CYRILLIC, pii.CYRILLIC_VOWELS) if other else (pii.LETTERS, pii.VOWELS)
    last = "".join(sets[i % 2][int(code[19 + i], 16)] for i in range(12 if attempt else 8))
    given = pii.NAMES[other, of[0]][number[0] % 16].lower()
    return of[:2] + (f"{given} {last}" if " " in of else last)


def plainly(texts, key):
    """The texts with surrogates."""
    found = [plain_entities(t) if t is not None else None for t in texts]
    corpus = {(k, of) for f in found if f for k, of, _ in f if k}
    genders = {}
    for k, of in corpus:
        if k == "name" and of[0] != "?":
            genders[of[2:]] = min(genders.get(of[2:], "z"), of[0])

    def whose(kind, of):
        if kind != "name" or of[0] != "?":
            return of
        return (genders.get(of[2:]) or "mf"[xxhash.xxh64_intdigest(of[2:].encode(), 42) % 2]) + of[1:]

    everyone = {(k, whose(k, of)) for k, of in corpus}

    def apart(kind, to):
        return (kind, to[2:].split(" ")[-1] if kind == "name" else to)

    taken, left, of = {apart(*e) for e in everyone}, sorted(everyone), {}
    for attempt in range(40):
        tried = [(e, plain_surrogate(*e, attempt, key)) for e in left]
        free = {}
        for e, to in tried:
            if apart(e[0], to) not in taken:
                free.setdefault(apart(e[0], to), (e, to))
        of |= dict(free.values())
        taken |= set(free)
        left = [e for e in left if e not in of]

    def shown(kind, to, m):
        if kind == "name":
            title, bare = re.fullmatch(r"(\S+ )(.*)", m).groups()
            to = to[2:] if " " in bare else to.split(" ")[-1].split(":")[-1]
            return title + (to.upper() if bare == bare.upper() else to.title())
        if kind == "email":
            return to.upper() if m == m.upper() else to
        if kind == "ip":
            return to
        digits = iter(re.sub(r"\D", "", to))
        return "".join(next(digits) if c.isdigit() else c for c in m)

    return [None if f is None else "".join(m if not k else shown(k, of[k, whose(k, o)], m) for k, o, m in f) for f in found]


def mixed_texts():
    r, out = random.Random(3), []
    parts = [
        "8.8.8.8", "+1 22 33", "+12233", "(12)345678", "1.2.3.4.5", "256.1.1.1", "10.0.0.255", "Bob.42@Mail7.example.com", "BOB.42@MAIL7.EXAMPLE.COM", "a@b.co", "x@y", "4041894974608795", "4041 8949 7460 8795",
        "4041-8949-7460-8796", "378282246310005", "123-45-6789", "626-555-5759", "+1 (626) 555-5759", "+16265555759", "+49 30 1234567", "Mr John Smith", "Mr. Smith", "Dr John Smith", "Dr Smith", "Mrs Smith", "Frau Anna Lee",
        "MR SMITH", "Dr Lee", "Herr Müller", "г-жа Мария Петрова", "г-н Петрова", "Dr Иван Ли", "Dr Kim", "Mr JOHN SMITH", "Señora Ana Kim", "Madame Curie", "Dr Marie Curie", "and", "the 12 of", "3.5", "#",
    ]
    for i in range(150):
        own = prose(i, 12).split()
        for _ in range(r.randrange(7)):
            own.insert(r.randrange(len(own)), r.choice(parts) + r.choice(["", ",", "."]))
        out.append(r.choice([" ", "\n", "  "]).join(own))
    return [*out, None, "", *parts, *out[:3]]


def test_against_brute_force(spark, key):
    texts = mixed_texts()
    out = replaced(spark, list(enumerate(texts)))
    got = [out[k]["text"] for k in range(len(texts))]
    expected = plainly(texts, key)
    assert [(t, g, e) for t, g, e in zip(texts, got, expected) if g != e] == []
    assert sum(t != g for t, g in zip(texts, got)) > 100


def test_names_are_resolved_to_persons(spark):
    rows = [(1, "Mr John Smith came. Mr Smith sat. Dr John Smith spoke; Dr Smith left Mrs Smith."), (2, "Dr John Smith again"), (3, "Dr Smith, as Dr John Smith is called")]
    out = replaced(spark, rows)
    he, alone, doctor, short, she = re.match(r"Mr (\w+ \w+) came. Mr (\w+) sat. Dr (\w+ \w+) spoke; Dr (\w+) left Mrs (\w+)\.", out[0]["text"]).groups()
    assert he == doctor and he.split()[1] == alone == short != she and he.split()[0] in pii.NAMES[False, "m"]
    assert out[1]["text"] == f"Dr {he} again" and out[2]["text"] == f"Dr {alone}, as Dr {he} is called"


def test_key_of_the_session(spark, key):
    spark.conf.unset(pii.SECRET)
    try:
        drawn = pii.secret(spark)
        assert len(drawn) == 64 and pii.secret(spark) == drawn
    finally:
        spark.conf.set(pii.SECRET, key)
    assert pii.secret(spark) == key


def luhn(number):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def replaced(spark, rows, **more):
    return {k: r for k, r in enumerate(pii.replaced(documents(spark, rows), **more).orderBy("_id").collect())}


def test_surrogates_keep_kind_format_and_coreference(spark):
    out = replaced(spark, [(1, TEXT), (2, "Mr. John Smith of bob.42@mail7.example.com"), (2, None), (3, "clean 9.9. text")])
    text = out[0]["text"]
    for original in ("42@", "626", "4041894974608795", "4041 8949", "39.197", "John", "Smith", "Anna", "Мария", "123-45-6789", "378282246310005"):
        assert original not in text
    assert "4041894974608796" in text and "1.2.3 or 1.2.3.4.5" in text
    mails = re.findall(r"\S+@\S+\.example\.org", text)
    assert len(mails) == 2 and mails[0].rstrip(",") == mails[1].rstrip(",")
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{8}\.example\.org", mails[0])
    phones = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+\d{11})\.", text)
    assert re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2])
    cards = re.search(r"Card (4\d{15}), (4\d{3} \d{4} \d{4} \d{4}) ", text)
    assert cards[1] == cards[2].replace(" ", "") and luhn(cards[1])
    assert luhn(re.search(r"amex (3\d{14})\.", text)[1]) and re.search(r"SSN 9\d\d-\d\d-\d{4},", text)
    assert all(0 <= int(x) <= 255 for x in re.search(r"IP ([\d.]+),", text)[1].split("."))
    man, woman = re.search(r"Mr\. (\w+ \w+)", text)[1], re.search(r"Mrs\. (\w+) ", text)[1]
    assert man.split()[0] in pii.NAMES[False, "m"] and woman in pii.NAMES[False, "f"] and re.search(r"г-жа (\w+) ", text)[1] in pii.NAMES[True, "f"]
    assert out[1]["text"] == f"Mr. {man} of {mails[0].rstrip(',')}" and out[2]["text"] is None and out[3]["text"] == "clean 9.9. text"
    assert replaced(spark, [(1, TEXT)], key="other")[0]["text"] != text


def test_shortest_entity_of_each_branch_alone_in_a_text(spark):
    alone = {
        "a@b.co": "email", "8.8.8.8": "ip", "378282246310005": "card", "123-45-6789": "ssn", "(12)345678": "phone", "+1(12)345678": "phone",
        "+12233": "phone", "+1234567": "phone", "+1 22 33": "phone", "+1.22-33": "phone", "123.456.7890": "phone", "Mr Li": "name", "г-н Ли": "name",
    }
    rows = [(k, f"see {m} now") for k, m in enumerate(alone)]
    out = replaced(spark, rows, counts=True)
    for k, (m, kind) in enumerate(alone.items()):
        assert m not in out[k]["text"] and {c: out[k][f"n_{c}"] for c in pii.KINDS if out[k][f"n_{c}"]} == {kind: 1}, m


def test_meeting_surrogates_are_told_apart(spark, monkeypatch):
    real = pii.surrogate
    from pyspark.sql import functions as F

    def few(kind, of, attempt, key):
        """Only as many surrogates as the attempts allow, and the first is an entity of the corpus."""
        return F.when(kind == "email", F.concat(F.lit("u"), (attempt + 1).cast("string"), F.lit("@x.org"))).otherwise(real(kind, of, attempt, key))

    monkeypatch.setattr(pii, "surrogate", few)
    rows = [(i, f"to u{i}@x.org and u1@x.org") for i in range(1, 8)] + [(3, "to u3@x.org and u1@x.org")]
    out = replaced(spark, rows)
    of = {}
    for (_, t), r in zip(rows, out.values()):
        for a, b in zip(t.split()[1::2], r["text"].split()[1::2]):
            assert of.setdefault(a, b) == b
    assert len(set(of.values())) == 7 and not set(of.values()) & set(of)


def test_difficult_rows_and_columns(spark, tmp_path):
    docs = documents(spark)
    out = pii.replacing(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    at = saved(spark, tmp_path, documents=documents(spark, odd_rows() + [(99, TEXT)]))
    found = {r["doc_id"]: r for r in pii.surrogates(spark, at).collect()}
    assert [found[99][f"n_{k}"] for k in pii.KINDS] == [2, 1, 3, 1, 2, 3] and found[1]["n_email"] == 0
    assert pii.replaced(docs.limit(0)).count() == 0
