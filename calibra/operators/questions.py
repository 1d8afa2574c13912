"""Typed question specs (U1): ``choice``, ``score`` (ordinal rubric), ``noul``.

A spec is plain driver-side configuration -- a handful of questions with a
handful of options -- so it is compiled into literal expressions, never
shipped as data.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from calibra.operators.labels import DEPARTMENTS, URGENCY_RUBRIC

QUESTION_TYPES = ("choice", "score", "noul")


@dataclass(frozen=True)
class Option:
    label: str
    description: str = ""
    words: tuple[str, ...] = ()

    def criteria(self) -> tuple[str, ...]:
        """Criteria: explicit words or word sequences, else the words of the description."""
        if self.words:
            return tuple(w.lower() for w in self.words)
        return tuple(w for w in re.split(r"[\W\d_]+", self.description.lower()) if w)


@dataclass(frozen=True)
class Question:
    name: str
    type: str
    options: tuple[Option, ...] = ()
    cues: tuple[str, ...] = ()          # noul: words that raise the probability
    bias: float = -2.0                  # noul: logistic intercept
    weight: float = 1.0                 # noul: logistic slope per 100 tokens

    def __post_init__(self):
        if self.type not in QUESTION_TYPES:
            raise ValueError(f"question {self.name!r}: type must be one of {QUESTION_TYPES}")
        if self.type in ("choice", "score") and not self.options:
            raise ValueError(f"question {self.name!r}: a {self.type} question needs options")

    @property
    def labels(self) -> list[str]:
        if self.type == "score":
            return [str(i) for i in range(len(self.options))]
        return [o.label for o in self.options]


@dataclass(frozen=True)
class QuestionSpec:
    questions: tuple[Question, ...] = field(default_factory=tuple)

    def __getitem__(self, name: str) -> Question:
        for q in self.questions:
            if q.name == name:
                return q
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [q.name for q in self.questions]


def build_questions(department_words: dict | None = None, urgency_words=None,
                    churn_cues=(), refund_cues=()) -> QuestionSpec:
    """The triage spec: 8-way department choice, 3-level urgency score, two
    yes/no signals. Criteria words default to the option descriptions."""
    dept = tuple(Option(name, desc, tuple((department_words or {}).get(name, ())))
                 for name, desc in DEPARTMENTS.items())
    urg = tuple(Option(line.split(":")[0], line, tuple(urgency_words[i]) if urgency_words else ())
                for i, line in enumerate(URGENCY_RUBRIC))
    return QuestionSpec((
        Question("department", "choice", dept),
        Question("urgency", "score", urg),
        Question("churn_risk", "noul",
                 cues=tuple(churn_cues) or ("cancel", "leave", "dissatisfied")),
        Question("refund_requested", "noul",
                 cues=tuple(refund_cues) or ("refund", "return", "money")),
    ))


def triage_preset() -> QuestionSpec:
    """A second, generic spec run beside the triage spec."""
    return QuestionSpec((
        Question("sentiment", "choice",
                 (Option("negative", "angry upset bad problem"),
                  Option("neutral", "question information request"),
                  Option("positive", "thanks great happy"))),
        Question("priority", "score",
                 (Option("later", "whenever later"), Option("today", "today soon"),
                  Option("now", "now immediately asap"))),
        Question("needs_reply", "noul", cues=("please", "help", "how")),
    ))


def spec_from_options(name: str, options: dict, qtype: str = "choice") -> QuestionSpec:
    """One-question spec from ``{label: [criteria words]}``."""
    return QuestionSpec((Question(name, qtype, tuple(Option(k, "", tuple(v)) for k, v in options.items())),))
