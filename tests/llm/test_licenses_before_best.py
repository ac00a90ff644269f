from lodestone.llm import licenses


def test_fuzzy_place_right_before_a_better_one():
    notice = "licensed under the apache license version two"
    searcher = licenses.Searcher({notice: "apache"}, {})
    near, best = notice.replace("apache", "apach"), notice
    assert searcher.errors[0] > 0
    for places, edits in (((near, best), [1, 0]), ((best, near), [0, 1]), ((near, best, near), [1, 0, 1])):
        text = " ".join(places)
        found = searcher(text.encode().split())
        assert [x[3] for x in found] == edits
        assert [f" {text} "[x[1] : x[2]] for x in found] == list(places)
