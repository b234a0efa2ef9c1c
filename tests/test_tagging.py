import json

import pytest

from linkloom.config import TagConfig
from linkloom.operators import tagging

# One entry for each rule of the dictionary.
TAGS = TagConfig({
    "recipe(s)": {}, "oven": {"alt": "stove"}, "sourdough": {"implies": "bread"}, "bread": {},
    "pressurecooker": {"alt": "pressure(-)cooker(s)"}, "salt&co": {"internal": "saltandco", "symbol": True},
    "tea": {"internal": "teadrink", "excludes": ["tea towel", "high tea"]},
    "k": {"internal": "kvitamin"}, "q++": {"internal": "qplusplus", "symbol": True},
    "~~~": {"internal": "waves", "symbol": True},
})

# Title -> tags, a sentence for each rule.
CASES = {
    "My grandmother's recipe": ["recipe"], "Forty recipes": ["recipe"],  # plural
    "A stove is no oven": ["oven"], "Only a STOVE": ["oven"],  # other name, any case
    "Sourdough, twice risen": ["bread", "sourdough"],  # implied
    "Sourdough is bread": ["bread", "sourdough"],  # implied and named
    "Pressure cooker": ["pressurecooker"], "pressure-cookers, compared": ["pressurecooker"],  # hyphen or blank
    "Pressurecooker.test - the test of a pressure cooker": ["pressurecooker"],
    "Salt&Co, bankrupt": ["saltandco"], "Q++ and k": ["kvitamin", "qplusplus"],  # symbols, internal names
    "~~~ by the sea": ["waves"],
    "A tea towel": [], "High tea at noon": [], "Tea after high tea": ["teadrink"],  # exclusions
    "tea towel and tea": ["teadrink"], "High-tea": [],
    "Rock-k": [], "We'k": [], "": [], "Nothing to see": [],  # a letter inside a word, no tag at all
}


def test_titles(apply):
    got = apply(lambda c: tagging.title_tags(c, TAGS), list(CASES))
    assert dict(zip(CASES, got)) == CASES


def test_search_mapping(apply):
    words = ["q++", "qplusplus", "K", "kvitamin", "salt&co", "saltandco", "stove", "oven", "tea", "nothing"]
    assert apply(tagging.internal_tag(TAGS), words) == [
        "qplusplus", "qplusplus", "kvitamin", "kvitamin", "saltandco", "saltandco", "oven", "oven", "teadrink", None]


def test_display(apply):
    shown = apply(lambda c: tagging.display_tag(c, TAGS), ["saltandco", "qplusplus", "kvitamin", "Bread"])
    assert shown == ["salt&co", "q++", "k", "bread"]


@pytest.mark.parametrize("tag,forms", [
    ("a(-)b", ["a-b", "a b"]), ("x(s)", ["x", "xs"]),
    ("3(-)dim(s)", ["3-dim", "3-dims", "3 dim", "3 dims"])])
def test_spellings(tag, forms):
    assert tagging.spellings(tag) == forms


def test_config_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"tagger": {"tags": {"g": {"zig": {}}, "h": {"c++": {"symbol": True}}}}}))
    assert set(TagConfig.from_json(str(path)).tags) == {"zig", "c++"}


def test_the_default_dictionary_is_empty(apply):
    assert apply(lambda c: tagging.title_tags(c, TagConfig()), ["Bread and tea", ""]) == [[], []]
    grown = TagConfig().with_words(["bread"])
    assert apply(lambda c: tagging.title_tags(c, grown), ["Bread and tea"]) == [["bread"]]
