"""Large lexicons of any patterns: what a match must contain, and equal hits on all ways."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekloom.functions.patterns import grams, literal_runs
from weekloom.operators import entities


def test_runs_leave_out_what_may_be_missing():
    assert literal_runs("abc") == [["abc"]]
    assert literal_runs("ab?cd|E+f*g") == [["a", "cd"], ["e", "g"]]
    assert literal_runs(r"a\.b\d{2,}x{0}yz") == [["a.b", "yz"]]
    assert literal_runs("(foo|bar)baz[a-z]qu[[x]y]x") == [["baz", "qu", "x"]]
    assert literal_runs(r"\p{Lu}ab\pLcd") == [["ab", "cd"]]
    assert literal_runs("(a(b)c)?") == [[]] and literal_runs("é?ab") == [["ab"]]
    for odd in (r"\Qa|b\E", r"(?x)a b", r"\x41bc", "(ab", "ab)", r"(a)\1", "[]a]", "[ab"):
        assert literal_runs(odd) is None and grams(odd) == [[""]]
    assert grams("abcd|x|.*|") == [["abc", "bcd"], ["x"], [""], [""]]


ATOM = st.sampled_from(["a", "b", "c", "ab", ".", "[bc]", r"\.", "(?:ab|c)", "(b)", r"\w", "é"])
PIECE = st.tuples(ATOM, st.sampled_from(["", "", "?", "*", "+", "{2}", "{0,1}", "+?"])).map("".join)
PATTERN = st.lists(st.lists(PIECE, max_size=4).map("".join), min_size=1, max_size=3).map("|".join)


@settings(max_examples=400, deadline=None)
@given(PATTERN, st.text(alphabet="abcé. ", max_size=12))
def test_every_match_holds_a_gram_of_its_pattern(pattern, text):
    if re.search(pattern, text, re.I):
        assert any(all_of and any(g in text.lower() for g in all_of) for all_of in grams(pattern))
        # Each branch names groups that all its matches hold.
        for branch, held in zip(pattern.split("|"), grams(pattern)) if "(" not in pattern else ():
            m = re.search(branch, text, re.I)
            assert m is None or all(g in m.group(0).lower() for g in held)


PATTERNS = [
    "new york|york", "Saint-[EÉ]tienne", r"F\.?C\.?", "straße", "the", "of the", "[0-9]{4}",
    "(?:foo|bar) ?fighters", r"\w+ville", "a|b", "İstanbul|kelvin", "x?", "müller|muller", "o'neill",
]
TEXTS = [
    "New York and new  york, YORK_1 york", "saint-étienne SAINT-ETIENNE Saint", "FC f.c. F.C fc.",
    "Straße STRAẞE strasse", "The of THE of the", "1999 20000 2024", "Foo Fighters barfighters fighters",
    "Nashville ville", "a b ab", "istanbul İSTANBUL Kelvin KELVIN", "", None, "the " * 3000, "Müller MULLER O'Neill",
    "The of THE of the",
]


def test_index_and_inline_find_the_same(spark):
    lexicon = spark.createDataFrame(
        [(i, i, f"n{i}", p) for i, p in enumerate(PATTERNS)], "entity_id int, ord int, name string, pattern string"
    )
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, full_text string")
    def hits(limit):
        found = entities.explode_hits(entities.mention_hits(docs, lexicon, inline_limit=limit), ["id"])
        return sorted(tuple(r) for r in found.collect())
    assert hits(0) == hits(64) and len(hits(0)) == 20


def test_patterns_do_not_enter_the_plan(spark):
    lexicon = spark.range(200).selectExpr(
        "cast(id as int) entity_id", "cast(id as int) ord", "'n' name", "concat('zq+', id, 'x') pattern"
    )
    docs = spark.createDataFrame([(1, "zqqq7x zq7x zq8")], "id int, full_text string")
    out = entities.mention_hits(docs, lexicon)
    assert "zq+7x" not in out._jdf.queryExecution().toString()
    assert [(h["entity_id"], h["cnt"]) for h in out.first()["hits"]] == [(7, 2)]
