import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import licenses
from leafmill.llm.queries import _license_pattern, _licenses_sql, op4_licenses

LICENSES, NOTICES = licenses.TEMPLATES, licenses.NOTICES
SCANNER = licenses.Scanner({**LICENSES, **NOTICES}, licenses.PHRASES)
MIT = re.sub(r"<<var[^>]*>>", "2024 A. Person", re.sub(r"<<(begin|end)Optional>>", "", LICENSES["MIT"]))


def scan(text):
    return SCANNER(text.encode())


def labels(text):
    return {s[0] for s in scan(text)[3]}


def plain(markup, optional=True):
    """The text of a template: each variable one or two words, with or without the optional regions."""
    if not optional:
        markup = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", markup, flags=re.S)
        markup = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", markup, flags=re.S)
    fill = re.sub(r"<<var[^>]*match=(\d+)>>", lambda m: " thing " * min(2, int(m[1])), markup)
    return re.sub(r"<<(begin|end)Optional>>", " ", fill)


def test_optional_and_replaceable_regions():
    n, starts, base, spans = scan("intro words " + MIT + " tail")
    assert base == ["mit"] and starts == [2] and spans == [("MIT", 2, n - 1)]
    assert labels(MIT.replace("associated documentation", "associated other documentation")) == set()
    assert labels("Released " + MIT.replace("MIT", "under the MIT", 1)) == {"MIT", "MIT-line"}
    gpl = scan("This work is licensed under the GNU General Public License, version 3.")
    assert gpl[2] == ["gpl"] and gpl[3] == [("GPL-line", 0, 12)]
    assert scan("mit licenses, mitlicense, general public-spirited license")[1:] == ([], [], [])


@pytest.mark.parametrize("label", [*LICENSES, *NOTICES])
def test_each_template_accepts_its_own_text(label):
    markup = {**LICENSES, **NOTICES}[label]
    for text in (plain(markup), plain(markup, optional=False), plain(markup).upper().replace(" ", " \n * ")):
        assert label in labels(text) and label in labels(f"before it {text} after it")


@pytest.mark.parametrize("label", [*LICENSES, *NOTICES])
def test_an_altered_word_anywhere_is_rejected(label):
    text = plain({**LICENSES, **NOTICES}[label], optional=False)
    words = [w.decode() for w in licenses.words(text.encode())]
    fixed = [i for i, w in enumerate(words) if w != "thing"]
    for i in fixed:
        # A missing first or last word may be made up by what follows; a strange word never is.
        assert label not in labels(" ".join([*words[:i], "zzz", *words[i + 1 :]])), (i, words[i])
    for i in fixed[1:-1]:
        if words[i + 1] != words[i] and words[i - 1] != "thing" and words[i + 1] != "thing":
            assert label not in labels(" ".join(words[:i] + words[i + 1 :])), (i, words[i])


def test_relatives_are_told_apart():
    own = {label: labels(plain(markup)) for label, markup in LICENSES.items()}
    assert all(found & set(LICENSES) == {label} for label, found in own.items())
    for label in NOTICES:
        if label.endswith("or-later"):
            assert labels(plain(NOTICES[label])) == {label}
    assert labels("licensed under the Apache License, Version 2.0 (the License) as amended") == {"Apache-2.0-line"}


def test_scores_of_licenses_notices_and_phrases(spark):
    texts = [MIT, "Released under the MIT License.", "an MIT license of sorts", "nothing", plain(NOTICES["Apache-2.0"])]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.score for r in rows] == [1.0, 0.75, 0.5, 0.0, 0.75]
    assert [r.labels for r in rows] == ["MIT,mit", "MIT-line,mit", "mit", "", "Apache-2.0,Apache-2.0-line,apache"]
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), templates={"MIT-line": "a"})


def test_the_oracle_reads_markup_like_the_automata():
    for label, markup in {**LICENSES, **NOTICES}.items():
        assert _license_pattern(markup) == licenses.to_regex(markup), label


def test_query_on_documents_that_hold_whole_texts(spark, tmp_path):
    texts = [plain(m, o) for m in (*LICENSES.values(), *NOTICES.values()) for o in (True, False)]
    texts += [t.replace(" the ", " some ", 1) for t in texts] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        db.execute(_licenses_sql())
        names = [d[0] for d in db.description]
        want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in db.fetchall()}
    got = {r.doc_id: r.asDict() for r in op4_licenses(spark, str(tmp_path)).collect()}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d x".split()), max_size=9))
def test_automaton_equals_regular_expression(text):
    template = "<<beginOptional>>x<<endOptional>> a <<beginOptional>>b <<var;match=2>> c<<endOptional>> <<var;match=1>> d"
    a, words = licenses.Automaton.of(template), [w.encode() for w in text]
    line, pattern = " ".join([*text, ""]), re.compile(licenses.to_regex(template).removeprefix("(?:^| )"))
    for i in range(len(text)):
        rest = " ".join([*text[i:], ""])
        ends = [j for j in range(i + 1, len(text) + 1) if pattern.fullmatch(" ".join([*text[i:j], ""]))]
        assert a.longest(words, i) == max(ends, default=i)
        assert bool(pattern.match(rest)) == bool(ends)
    assert bool(re.search(licenses.to_regex(template), line)) == any(a.longest(words, i) > i for i in range(len(text)))


def test_words():
    text = "Ünïcode_x2 ABC-É 12.5\x00z"
    low = "".join(c.lower() if c.isascii() else c for c in text)
    assert [w.decode() for w in licenses.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == 0 and by[3].labels == "" and by[3].first_word is None
    assert by[6].n_words == 20_001 and by[7].n_words == 5
    assert licenses.scan(no_docs).count() == 0


def test_markup_errors():
    with pytest.raises(ValueError):
        licenses.parse("<<beginOptional>> a")
    with pytest.raises(ValueError):
        licenses.Automaton.of("<<var;match=3>>")
