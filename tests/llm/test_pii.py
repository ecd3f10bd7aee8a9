"""Pseudonyms: every set is permuted within itself, lengths stay, any text is safe, the key leads back."""

import datetime
import random
import unicodedata
import warnings

import pytest

from annotara.llm import pii

WRITE, BACK = pii.writer(b"k", False, True), pii.writer(b"k", True, True)


def changed(text, write=WRITE):
    return pii.pseudonymised(text, write)[0]


def dates(years, day_first, one_digit, mark="/"):
    for y in years:
        d = datetime.date(y, 1, 1)
        while d.year == y:
            if not one_digit or (d.day < 10 and d.month < 10):
                a, b = (d.day, d.month) if day_first else (d.month, d.day)
                yield f"{a}{mark}{b}{mark}{y:04d}" if one_digit else f"{a:02d}{mark}{b:02d}{mark}{y:04d}"
            d += datetime.timedelta(days=1)


@pytest.mark.parametrize("one_digit", [False, True])
def test_dates_with_the_year_last_never_merge(one_digit):
    both = set(dates(range(1995, 2005), True, one_digit)) | set(dates(range(1995, 2005), False, one_digit))
    out = {s: changed(s) for s in both}
    assert len(set(out.values())) == len(both) and all(len(a) == len(b) and a != b for a, b in out.items())
    assert all(changed(b, BACK) == a for a, b in out.items())


def test_all_dates_of_a_layout_are_permuted():
    """One digit each: the set of 81 dates a year from 1900 to 2099 maps onto itself."""
    whole = set(dates(range(1900, 2100), True, True, "."))
    assert len(whole) == 81 * 200 and {changed(s) for s in whole} == whole


def test_dates_of_other_years():
    for s in ("0001-01-01", "1066-10-14", "9999-12-31", "14.10.1066", "2400-02-29", "1899-12-31"):
        t = changed(s)
        assert t != s and len(t) == len(s) and changed(t, BACK) == s and not 1900 <= int(max(t.replace(".", "-").split("-"), key=len)) < 2100
    for s in ("0000-01-01", "2021-02-29", "1900-02-29", "31/04/2000", "13/13/2000", "2021-13-01", "00/01/2000"):
        assert changed(s) == s


def test_digits_of_any_script_are_marks():
    digits = [chr(c) for c in range(0x110000) if chr(c).isdigit() or unicodedata.category(chr(c)) in ("Nd", "Nl", "No")]
    assert len(digits) > 700
    for c in digits:
        for text in (f"(555){c}123-4567", f"{c}4539578763621486{c}", f"2021-03-0{c}", f"555-123-456{c}", f"1.2.3.{c}", f"a{c}@x.org", f"123-45-678{c}"):
            new = changed(text)
            assert len(new) == len(text) and new.count(c) == text.count(c) or c.isascii()


def test_phone_numbers_of_one_layout_never_merge():
    rng = random.Random(1)
    numbers = {f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10_000):04d}" for _ in range(4000)}
    out = {s: changed(s) for s in numbers}
    assert len(set(out.values())) == len(numbers) and all(changed(b, BACK) == a for a, b in out.items())
    assert all((a[0] > "1" and a[4] > "1") == (b[0] > "1" and b[4] > "1") for a, b in out.items())


@pytest.mark.parametrize("size", [2, 3, 4, 5, 10, 26, 99, 1000, 1001])
def test_no_value_stays(size):
    for key in (b"a", b"b", b"c"):
        p = pii.Permutation(key)
        out = [p(x, size, "t") for x in range(size)]
        assert sorted(out) == list(range(size)) and all(x != y for x, y in enumerate(out))
        assert [pii.Permutation(key, True)(y, size, "t") for y in out] == list(range(size))


def test_values_walked_past_stay_out():
    p, back = pii.Permutation(b"k"), pii.Permutation(b"k", True)
    odd = [x for x in range(501) if x % 2]
    out = [p.within(x, 501, "t", lambda x: x % 2 == 1) for x in odd]
    assert sorted(out) == odd and [back.within(y, 501, "t", lambda x: x % 2 == 1) for y in out] == odd


TEXT = "Mail bob.7@mail3.example.com, +1 (269) 555-3296 4539578763621486 or 10.0.0.255; SSN 123-45-6789 on 2021-02-28, 3/4/1999, GB82 WEST 1234 5698 7654 32.\n"


def test_the_key_leads_back_and_another_doesn_t(spark):
    rows = spark.createDataFrame([(1, TEXT, "x", 5), (2, None, None, None), (3, "", "y", 0), (1, TEXT, "x", 5)], "doc_id long, text string, __text string, key long")
    hidden = pii.pseudonymise(rows, b"secret")
    assert hidden.columns == rows.columns
    got = hidden.collect()
    assert got[0].text != TEXT and len(got[0].text) == len(TEXT) and got[0] == got[3] and (got[1].text, got[2].text) == (None, "")
    assert [r.text for r in pii.pseudonymise(hidden, b"secret", back=True).collect()] == [TEXT, None, "", TEXT]
    assert pii.pseudonymise(rows, b"other").first().text != got[0].text


def test_the_key_comes_from_the_session(spark):
    rows = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    with pytest.warns(UserWarning):
        plain = pii.query(rows).first().text
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            own = pii.query(rows).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert own == pii.query(rows, b"secret").first().text != plain


def test_long_texts_are_read_as_a_whole(spark):
    rng = random.Random(4)
    filler = " ".join("".join(rng.choice("abcde0123456789.,-") for _ in range(rng.randint(1, 9))) for _ in range(150_000))
    text = TEXT + filler + TEXT
    assert len(text) > 800_000
    new = changed(text)
    assert len(new) == len(text) and new.startswith(first := changed(TEXT)) and new.endswith(first)
    got = pii.query(spark.createDataFrame([(1, text), (2, "7" * 1_000_000), (3, "AB12" * 250_000)], "doc_id long, text string"), b"k").collect()
    assert got[0].text == new and got[1].text == "7" * 1_000_000


def test_accounts_need_real_check_digits():
    """99, 00 and 01 leave the right remainder too, but no bank writes them."""
    account = next(f"{a:018d}" for a in range(10_000) if pii._rest_97("DE", "99", f"{a:018d}") == 1)
    assert changed(f"DE99{account}") == f"DE99{account}" and changed(f"DE02{account}") != f"DE02{account}"
