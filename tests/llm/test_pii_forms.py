"""Surrogates keep script, gender, case, country code, check digit and coreference; brute force finds the mentions."""

from __future__ import annotations

import regex

from quietcount.llm import pii

TEXTS = [
    "Dr Иван Петров wrote to Dr Anna Schmidt and Prof Ruth Weiß.",
    "Mr John Smith came. Mr Smith left; MR. Smith, Mr SMITH and Frau Smith stayed. Mr. Smith's hat.",
    "Mr McDonald met Miss Mary-Ann O'Brien and Herr Johann Wolfgang Goethe.",
    "John.Doe@Example.Com or john.doe@example.com or JOHN.DOE@EXAMPLE.COM",
    "+49 30 1234567, +49301234567, +353 1 234 5678, (212) 555-0123",
    "דוד@דואר.קום and иван@почта.рф",
    "4111 1111 1111 1111 and 4111111111111111 but 1234 5678 1234 5671",
    "Version 1.2.3.4, release: 10.0.0.7 but 10.0.0.8",
    "a" * 300_000 + " x@y.com",
    "x@y.com_foo@z.com",
    None,
    "",
]


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_forms_are_kept(spark):
    docs = spark.createDataFrame([(i % 12, t, "x", 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, uid string, n_ip int")
    rows = pii.pseudonymised(docs, "key").collect()
    assert len(rows) == 2 * len(TEXTS) and all(r.uid == "x" for r in rows)
    got = {r.doc_id: r.text for r in rows}
    assert all(got[r.doc_id] == r.text for r in rows)
    for r in rows:
        assert r.n_entities == len(regex.findall(pii.ANY, TEXTS[r.doc_id] or "")) == r.n_email + r.n_ip + r.n_ip6 + r.n_phone + r.n_card + r.n_person
    doctor = regex.fullmatch(r"Dr (\p{IsCyrillic}+) (\p{IsCyrillic}+) wrote to Dr (\w+) \w+ and Prof (\w+) \w+\.", got[0])
    assert doctor[1].lower().startswith(pii.CYRILLIC_MALE) and doctor[1][0].isupper()
    # a name that was drawn again and again has an end more
    assert doctor[3].startswith(pii.FEMALE_NAMES) and doctor[4].startswith(pii.FEMALE_NAMES)
    # a form of address in capitals counts too
    one = regex.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) left; MR\. (?P<capitals>\w+), Mr (\w+) and Frau (\w+) stayed\. Mr\. (\w+)'s hat\.", got[1])
    assert one["capitals"] == one[2]
    one = {1: one[1], 2: one[2], 3: one[3], 4: one[5], 5: one[6], 6: one[7]}
    assert one[2] == one[3] == one[5] == one[6] != "Smith" and one[4] == one[2].upper() and one[1].startswith(pii.MALE_NAMES)
    assert not any(n in got[2] for n in ("Donald", "Brien", "Mary", "Ann ", "Johann", "Goethe"))
    mails = got[3].split(" or ")
    assert mails[0].lower() == mails[1] == mails[2].lower() != "john.doe@example.com" and mails[2].isupper()
    assert [c.isupper() for c in mails[0]] == [c.isupper() for c in "John.Doe@Example.Com"]
    first, second, third, fourth = got[4].split(", ")
    assert first[:4] == "+49 " and second[:3] == "+49" and first.replace(" ", "") == second and third[:5] == "+353 " and fourth != "(212) 555-0123"
    assert regex.fullmatch(r"\p{IsHebrew}{3}@\p{IsHebrew}{4}\.קום and \p{IsCyrillic}{4}@\p{IsCyrillic}{5}\.рф", got[5])
    cards = regex.fullmatch(r"(\d{4} \d{4} \d{4} \d{4}) and (\d{16}) but (\d{4} \d{4} \d{4} \d{4})", got[6])
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2])
    assert got[7].startswith("Version 1.2.3.4, release: 10.0.0.7 but ") and not got[7].endswith("10.0.0.8")
    assert got[8].startswith("aaa") and not got[8].endswith("x@y.com")
    assert "@y.com" not in got[9] and "foo@z" not in got[9]
    assert got[10] is None and got[11] == ""
    other = {r.doc_id: r.text for r in pii.pseudonymised(docs, "another key").collect()}
    assert other[3] != got[3]
