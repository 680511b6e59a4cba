"""Broken prompt and response pairs (problem 3).

Ordered rules on the question and its answer; every rule that fires is reported, and the first one names the pair.

Defined cases: a null or blank answer is empty; a pair without a question (null or blank prompt, no user message
before the answer) is no pair; redelivered rows count once; roles are read without regard to case and blanks; records
without a record_id have no question. A very long answer is read whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of the rules; the first that fires names the pair.
RULES = ("empty", "refusal", "copy", "other_language", "truncated")

# Tokens that stand for no value.
_NO_VALUE = re.compile(r"[\W_]*(?:null|none|nil|nan|n/?a|undefined|empty|blank|missing|not available|no (?:answer|response|reply|output|content|value)(?: (?:given|provided))?)[\W_]*", re.I)
_ZERO_WIDTH = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_INVISIBLE = re.compile("[\\s\u00ad\u180e\u200b-\u200f\u2028-\u202f\u2060-\u2064\ufeff\x00-\x1f]+")

# Answer labels by language.
LABELS = {
    "en": ["Yes", "No", "Strongly agree", "Agree", "Uncertain", "Disagree", "Strongly disagree"],
    "de": ["Ja", "Nein", "Stimme völlig zu", "Stimme zu", "Unentschieden", "Lehne ab", "Lehne völlig ab", "Stimme nicht zu"],
    "fr": ["Oui", "Non", "Tout à fait d'accord", "Plutôt d'accord", "D'accord", "Incertain", "Plutôt pas d'accord", "Pas d'accord", "Pas du tout d'accord"],
    "es": ["Sí", "Muy de acuerdo", "De acuerdo", "Indeciso", "En desacuerdo", "Muy en desacuerdo"],
}
_LABEL_OF = {x.lower(): lang for lang, xs in LABELS.items() for x in xs}
_VERDICT = re.compile(r"(?:^|[\s.\n])(?:Answer|Final answer|Verdict|Antwort|Réponse|Respuesta)\s*:\s*([^\n]*)$", re.I)
_REASONED = re.compile(r"starts with answer|before the verdict|finish with your answer|end with (?:your|the) (?:answer|verdict)|then (?:give|state) (?:your|the|a) (?:answer|verdict)", re.I)
_LISTED = re.compile(r"yes or no|yes ?/ ?no|strongly agree[,;/ ]|(?:pick|choose) one", re.I)

# Frequent words by language.
_STOP = {
    "en": "the of and to in was for is that had by on with were not it would as from at his this which be no who an their have has will while under before over although without".split(),
    "fr": "le la les des du et est une un dans que qui pour par sur pas au aux ne se il elle avec ce cette été mais selon qu cents rien après dès sans leur".split(),
    "de": "der die das und ist nicht den dem des ein eine zu von mit für auf im wird dass daß sich auch hat wurde als nach bei ob im jahr etwa weil zugleich nichts bleibt länger".split(),
    "es": "el la los las de del y en que por para con un una se su al lo como fue pero tras sin según nada unos más ha haya".split(),
}
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in _STOP.items():
    for _word in _words:
        _LANGUAGES_OF[_word] = (*_LANGUAGES_OF.get(_word, ()), _lang)
_NAMED = {"english": "en", "englisch": "en", "englische": "en", "anglais": "en", "inglés": "en", "french": "fr", "französisch": "fr", "französische": "fr", "français": "fr", "francés": "fr", "german": "de", "deutsch": "de", "deutsche": "de", "allemand": "de", "alemán": "de", "spanish": "es", "spanisch": "es", "spanische": "es", "espagnol": "es", "español": "es"}
_ASKED = re.compile(rf"\b(?:in|into|to|ins|auf|en|al)\s+({'|'.join(_NAMED)})\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = re.compile("(?P<cyrillic>[Ѐ-ԯ])|(?P<greek>[Ͱ-Ͽ])|(?P<arabic>[؀-ۿ])|(?P<hebrew>[֐-׿])|(?P<devanagari>[ऀ-ॿ])|(?P<cjk>[぀-ヿ㐀-鿿가-힯])")
_OTHER_SCRIPTS = re.compile("[Ͱ-ԯ֐-ۿऀ-ॿ぀-ヿ㐀-鿿가-힯]")

_LEAD = r"(?:(?:(?:i'm|i am|we are|we're) )?(?:very |so |truly )?sorry|i apologi[sz]e|apologies|unfortunately|regrettably|with respect|as an? (?:ai|assistant|(?:ai |large )?language model)(?: \w+)?|thank(?:s| you) for (?:asking|your question))[\s,;:.–—-]*(?:but|however|and)?[\s,;:–—-]*"
_VERBS = r"(?:help|assist|answer|comply|provide|give|offer|take|respond|reply|discuss|comment|choose|share|do (?:that|this|so)|engage|fulfil|complete|express|support|advise|continue|make|decide|speak|recommend|process|write|produce|judge|say more)"
_CORE = rf"""(?:
 (?:i|we)\ (?:can't|cannot|can\ not|could\ not|couldn't|won't|will\ not)\ (?:be\ able\ to\ )?{_VERBS}\b
|(?:i'm|i\ am|we\ are|we're)\ (?:unable|not\ able|not\ allowed|not\ permitted|not\ in\ a\ position)\ to\b
|(?:i|we)\ (?:must|have\ to|will|would|'ll)?\ ?(?:respectfully\ )?decline\b
|(?:i'd|i\ would|i'll)\ (?:rather|prefer)\ not\b|i\ prefer\ not\b
|i\ (?:don't|do\ not)\ (?:feel\ comfortable|have\ (?:any\ )?(?:personal\ )?(?:opinions?|views?))
|i\ have\ no\ (?:personal\ )?(?:opinions?|views?)\b
|(?:that|this|it)\ is\ (?:not\ something|something)\ (?:that\ )?i\ (?:can|cannot|can't|am)
|(?:this|that|your|the)\ (?:request|question|topic)\ (?:falls|is)\ (?:outside|beyond)
|it\ would\ not\ be\ (?:appropriate|right|proper)
|(?:my|our)\ (?:guidelines|instructions|policies|policy|rules|training|principles|role)\ (?:do\ not|does\ not|don't|doesn't|will\ not|won't|cannot|can't|forbids?|prevents?|prohibits?|keeps?|stops?)
|i\ (?:don't|do\ not)\ (?:wish|want|think\ it|give|offer|take|provide|share|answer|express|weigh|comment)\b
|(?:that|this|it)\ (?:is|falls|lies|goes)\ (?:outside|beyond)\ (?:what|my|the\ scope)
|i\ will\ (?:leave|pass)|i\ (?:refuse|abstain)\b|no\ comment\b
|je\ (?:suis\ )?(?:désolée?|regrette)|désolée?\b|je\ ne\ (?:peux|puis|saurais|suis\ pas\ en\ mesure)|je\ (?:préfère\ ne|dois\ (?:refuser|décliner))
|es\ tut\ mir\ leid|leider\ (?:kann|darf|möchte|muss)|(?:ich|dazu|das|dabei)\ (?:kann|darf|möchte)\ (?:ich\ )?[^.]{{0,60}}nicht\b|ich\ bin\ nicht\ (?:in\ der\ lage|befugt)|ich\ muss\ (?:das\ )?ablehnen
|lo\ (?:siento|lamento)|no\ (?:puedo|me\ es\ posible|estoy\ en\ condiciones)|prefiero\ no\b|debo\ (?:negarme|declinar|rechazar)
)"""
_REFUSAL = re.compile(r"[\W_]*(?:" + _LEAD.replace(" ", r"\ ") + "){0,3}" + _CORE, re.I | re.X)
_REFUSES = re.compile(_CORE, re.I | re.X)
#: Words in sentences that refuse nothing; so many are an answer, whatever comes before.
_ANSWER_WORDS = 45

_ABBREVIATED = re.compile(r"(?:^|[\s(“\"])(?:v|vs|Tid|Mr|Mrs|Ms|Dr|St|No|Nos|[A-Z])\.$|Tid\. Rep\.$")
_CITED = re.compile(r"\d+ Tid\. Rep\. \d+ \(\d{4}\)$")
_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+[.)]|[a-z]\))\s*\S[^\n]*$|(?:^|[.!?\n]\s*)[A-Z][\w ]{2,40}: \w+(?:, \w+)+$")


def language(text: str) -> str | None:
    """en, fr, de or es by frequent words, a script's name for other scripts, None if nothing tells."""
    lowered = text.lower()
    words = _LETTERS.findall(lowered)
    if other := [] if text.isascii() else _OTHER_SCRIPTS.findall(lowered):
        scripts = [m.lastgroup for m in map(_SCRIPTS.match, other) if m]
        if 2 * len(scripts) > sum(map(len, words)):
            return max(set(scripts), key=scripts.count)
    score = dict.fromkeys(_STOP, 0.0)
    for w in words:
        if w in _LANGUAGES_OF:
            for lang in _LANGUAGES_OF[w]:
                score[lang] += 1 / len(_LANGUAGES_OF[w])
    best = max(score, key=score.__getitem__)
    rest = max(v for k, v in score.items() if k != best)
    return best if score[best] > 0 and score[best] >= 1.3 * rest else None


def _empty(answer: str) -> bool:
    return not re.search(r"[^\W_]", answer) or bool(_NO_VALUE.fullmatch(answer))


def _refuses(answer: str) -> bool:
    """The lead refuses, and what follows is no answer: few words outside sentences that refuse too."""
    text = answer.replace("’", "'")
    lead = _REFUSAL.match(text)
    if not lead:
        return False
    rest = re.split(r"(?<=[.!?])\s+", text[lead.end() :])[1:]
    return sum(sentence.count(" ") + 1 for sentence in rest if not _REFUSES.search(sentence)) < _ANSWER_WORDS


def _copy(question: str, answer: str) -> bool:
    """Nothing but the question, or nearly so: nearly all of the answer's three-word runs are the question's."""
    words, asked = re.findall(r"\w+", answer.lower()), re.findall(r"\w+", question.lower())
    if len(words) < 4 or len(words) < 0.4 * min(len(asked), 40):
        return False
    # A common run begins with a common word, so with fewer of these there are too many new runs.
    if sum(map(set(asked).__contains__, words)) < 0.6 * (len(words) - 2):
        return False
    grams = {tuple(asked[i : i + 3]) for i in range(len(asked) - 2)}
    own = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    new = sum(g not in grams for g in own)
    return new <= max(5, 0.1 * len(own)) and new <= 0.4 * len(own)


def _parsed(answer: str) -> object:
    """The JSON value of an answer, fenced or not; None if it is none or breaks off."""
    body = answer.strip()
    if body.startswith("```"):
        body, fence, _ = body[3:].removeprefix("json").rpartition("```")
        if not fence:
            return None
    try:
        return json.loads(body, strict=False)
    except ValueError:
        return None


def _strings(value: object) -> list[str]:
    """All texts inside a JSON value."""
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [text for part in inner for text in _strings(part)]


def _label_prefix(plain: str) -> bool:
    """The beginning of a label that is no label itself."""
    bare = re.sub(r"[\s.…,;:()\[\]—–-]+$", "", plain)
    return bare not in _LABEL_OF and any(x.startswith(bare) for x in _LABEL_OF)


def _truncated(reasoned: bool, listed: bool, answer: str) -> bool:
    end = answer.strip()
    if re.match(r"```|[\[{]\s*[\"\[{]", end):
        return _parsed(end) is None
    if end.lower() in _LABEL_OF or end.rstrip(".!").lower() in _LABEL_OF:
        return False
    if (listed or len(end) >= 2) and _label_prefix(end.lower()):
        return True
    last = end[end.rfind("\n") + 1 :]
    if reasoned:
        verdict = _VERDICT.search(last)
        return not verdict or verdict[1].strip().rstrip(".!”\"*").lower() not in _LABEL_OF
    if re.search(r"(?:\.\.|…|[,;:(\[{—–-])$", last):
        return True
    if end.count("“") > end.count("”") or end.count("(") > end.count(")"):
        return True
    if re.search(r"[.!?][”\"’')\]*]*$", last):
        return bool(_ABBREVIATED.search(last))
    return not (_CITED.search(last) or _ITEM.search(last) or end[-1] in "”\"»)]")


@lru_cache(4096)
def _wanted(question: str) -> frozenset[str]:
    """Languages an answer may be in: the question's own and those it asks for."""
    wanted = {_NAMED[m.lower()] for m in _ASKED.findall(question)}
    if own := language(question) or ("en" if _LISTED.search(question) else None):
        wanted.add(own)
    return frozenset(wanted)


def defects(question: str, answer: str | None) -> list[str]:
    """Every defect of an answer, in the order of RULES."""
    text = _INVISIBLE.sub(" ", answer or "").strip()
    if _empty(text):
        return ["empty"]
    if text[0] in "{[`" and (value := _parsed(text)) is not None:
        text = _INVISIBLE.sub(" ", "\n".join(_strings(value))).strip()
        if _empty(text):
            return ["empty"]
    found = []
    if _refuses(text):
        found.append("refusal")
    if _copy(question, text):
        found.append("copy")
    plain = text.rstrip(".!").lower()
    spoken = None if plain == "no" or _label_prefix(plain) else _LABEL_OF.get(plain) or language(text)
    if spoken and (wanted := _wanted(question)) and spoken not in wanted:
        found.append("other_language")
    if _truncated(bool(_REASONED.search(question)), bool(_LISTED.search(question)), _ZERO_WIDTH.sub("", answer or "")):
        found.append("truncated")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _defects(question: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([defects(q, a) for q, a in zip(question, answer)])


def prompt_question(prompt: str) -> F.Column:
    """The last user turn of a rendered prompt."""
    body = F.regexp_replace(F.col(prompt), r"\n*Assistant:\s*$", "")
    return F.trim(F.element_at(F.split(body, r"(?:^|\n\n)User: ?"), -1))


def rendered_pairs(train: DataFrame, pair_id: str = "train_id", prompt: str = "prompt_str", response: str = "response_str") -> DataFrame:
    """Pairs of rendered training rows: tab, pair_id, question, answer."""
    rows = train.where(F.col(prompt).isNotNull() & (F.col(prompt) != ""))
    return rows.select(F.lit("train").alias("tab"), F.col(pair_id).alias("pair_id"), prompt_question(prompt).alias("question"), F.col(response).alias("answer"))


def message_pairs(run: DataFrame) -> DataFrame:
    """Assistant messages with the nearest user message before them in the record.

    Redelivered rows sort next to each other and change nothing; the frame only looks back, so Spark streams through a
    record of any length.
    """
    role = F.lower(F.trim("role"))
    rows = run.where(F.col("record_id").isNotNull()).select("record_id", "turn", "msg_id", role.alias("role"), "content").where(F.col("role").isin("user", "assistant"))
    before = Window.partitionBy("record_id").orderBy("turn", "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct(F.coalesce("content", F.lit("")).alias("q"))), ignorenulls=True).over(before)
    pairs = rows.withColumn("asked", asked).where("role = 'assistant' AND asked IS NOT NULL")
    return pairs.select(F.lit("run").alias("tab"), F.col("msg_id").alias("pair_id"), F.col("asked.q").alias("question"), F.col("content").alias("answer"))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """Each defective pair once, with all defect types that fired."""
    judged = pairs.withColumn("defects", _defects(F.coalesce("question", F.lit("")), "answer"))
    return judged.where(F.size("defects") > 0).select("tab", "pair_id", "defects").distinct()


def named_defect(broken: DataFrame) -> DataFrame:
    """The first defect of each pair in the order of the rules; a pair delivered with two texts keeps the earlier rule."""
    rank = F.array_position(F.array(*[F.lit(x) for x in RULES]), F.col("defects")[0])
    best = broken.groupBy("tab", "pair_id").agg(F.min_by(F.col("defects")[0], rank).alias("defect"))
    return best.select("tab", "pair_id", "defect")
