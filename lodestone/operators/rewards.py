"""Rewards by name: components with parameters, versions, and scores rebuilt from stored provenance.

Rows have answer, final_answer, observations (array<string>), reason, searches, support_titles and found_titles
(array<string>), over_steps and empty_searches.  Provenance is JSON, ``{"<component>": {<parameters>}, ..., "_meta":
{"reward_version": ...}}``; a row is scored by its own provenance, or gets null if that isn't known.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def _if(condition: Column, value: Column | float) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))


def _right() -> Column:
    return T.norm(F.col("answer")) == T.norm(F.col("final_answer"))


def _answered() -> Column:
    return T.norm(F.col("final_answer")) != ""


def _keys(titles: str) -> Column:
    return F.array_distinct(F.transform(F.coalesce(titles, F.array().cast("array<string>")), lambda t: T.norm(t)))


def _complete() -> Column:
    return (F.size(_keys("support_titles")) > 0) & (F.size(F.array_except(_keys("support_titles"), _keys("found_titles"))) == 0)


def _evidence(_: Column) -> Column:
    said = T.norm(F.col("final_answer"))
    return _if((said != "") & F.exists(F.coalesce("observations", F.array().cast("array<string>")), lambda o: F.contains(T.norm(o), said)), 0.2)


def _f1(weight: Column) -> Column:
    score = T.reward_f1(T.answer_words(F.col("final_answer")), T.answer_words(F.col("answer")))
    return _if((F.col("reason") == "answer") & _answered(), weight * score)


def _coverage(_: Column) -> Column:
    wanted = _keys("support_titles")
    return _if(F.size(wanted) > 0, 0.2 * F.size(F.array_intersect(wanted, _keys("found_titles"))) / F.size(wanted))


#: Names, the parameter that each takes and its default; the name of its part of the reward.
COMPONENTS: dict[str, tuple[str, str | None, float, Callable[[Column], Column]]] = {
    "ExactMatchReward": ("exact_match", "weight", 1.0, lambda p: _if(_right(), p)),
    "EvidenceReward": ("evidence_supported", None, 0.0, _evidence),
    "AnswerTokenF1Reward": ("answer_token_f1", "weight", 0.2, _f1),
    "SupportCoverageReward": ("support_coverage", None, 0.0, _coverage),
    "SearchCostPenalty": ("search_cost", None, 0.0, lambda _: -0.03 * F.col("searches")),
    "RepeatedSearchPenalty": ("repeated_search", "penalty", -0.5, lambda p: _if(F.col("reason") == "repeated_action", p)),
    "InvalidActionPenalty": ("invalid_action", None, 0.0, lambda _: _if(F.col("reason") == "invalid_action", -0.5)),
    "MaxStepsPenalty": ("max_steps", None, 0.0, lambda _: _if(F.col("reason") == "max_steps", -0.25)),
    "UngroundedAnswerPenalty": ("ungrounded_answer", None, 0.0, lambda _: _if((F.col("searches") == 0) & ~_right(), -0.1)),
    "OverSearchAfterEvidencePenalty": ("over_search_after_evidence", "penalty", -0.2, lambda p: p * F.col("over_steps")),
    "EvidenceStopReward": ("evidence_stop", "weight", 0.3, lambda p: _if(_right() & _complete(), p)),
    "IncompleteEvidenceAnswerPenalty": ("incomplete_evidence_answer", "penalty", -0.15, lambda p: _if((F.col("searches") > 0) & _answered() & ~_complete(), p)),
    "EmptyEvidenceAnswerPenalty": ("empty_evidence_answer", "penalty", -0.1, lambda p: _if((F.col("searches") > 0) & _answered() & (F.col("empty_searches") == F.col("searches")), p)),
}
#: Versions that can be asked for, and those whose stored scores can be rebuilt.
VERSIONS = ("v096", "v098-answer-v1", "v102-oversearch-zero")
REBUILT = ("v096", "v098-answer-v1")


def provenance(version: str = "v096", over_search: float = -0.2, **weights: float) -> str:
    """The JSON of a version; ``weights`` adds the optional components (evidence_stop, incomplete, empty) where not 0."""
    if version not in VERSIONS:
        raise ValueError(f"unknown reward version: {version}")
    answer = "EvidenceReward" if version == "v096" else "AnswerTokenF1Reward"
    names: dict[str, dict] = {n: {} for n in ("ExactMatchReward", answer, "SupportCoverageReward", "SearchCostPenalty", "RepeatedSearchPenalty", "InvalidActionPenalty", "MaxStepsPenalty", "UngroundedAnswerPenalty")}
    names["OverSearchAfterEvidencePenalty"] = {"penalty": over_search}
    for key, name in (("evidence_stop", "EvidenceStopReward"), ("incomplete", "IncompleteEvidenceAnswerPenalty"), ("empty", "EmptyEvidenceAnswerPenalty")):
        if weights.get(key):
            names[name] = {COMPONENTS[name][1]: weights[key]}
    return json.dumps(names | {"_meta": {"reward_version": version}})


def parts(stored: Column) -> dict[str, Column]:
    """Each component of a row by its provenance: null where that doesn't name it."""
    out = {}
    for name, (part, parameter, default, score) in COMPONENTS.items():
        given = F.lit(default) if parameter is None else F.coalesce(F.get_json_object(stored, f"$.{name}.{parameter}").cast("double"), F.lit(default))
        out[part] = F.when(F.get_json_object(stored, f"$.{name}").isNotNull(), score(given))
    return out


def known(stored: Column, versions: tuple[str, ...] = REBUILT) -> Column:
    """Whether all of a provenance is known: a version of these, at least one component, each an object of parameters."""
    names = F.filter(F.json_object_keys(stored), lambda k: k != "_meta")
    version = F.coalesce(F.get_json_object(stored, "$._meta.reward_version"), F.lit("v096"))
    objects = [F.coalesce(F.startswith(F.get_json_object(stored, f"$.{n}"), F.lit("{")), F.lit(True)) for n in COMPONENTS]
    whole = (F.size(names) > 0) & (F.size(F.array_except(names, F.array(*[F.lit(n) for n in COMPONENTS]))) == 0) & version.isin(*versions)
    for x in objects:
        whole = whole & x
    return F.coalesce(whole, F.lit(False))


def total(stored: Column, versions: tuple[str, ...] = REBUILT) -> Column:
    """The reward by a row's provenance; null if that isn't known."""
    every = [F.coalesce(x, F.lit(0.0)) for x in parts(stored).values()]
    sums = every[0]
    for x in every[1:]:
        sums = sums + x
    return F.when(known(stored, versions), sums)
