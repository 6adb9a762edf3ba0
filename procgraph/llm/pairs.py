"""Broken prompt and response pairs (problem 2).

Method: an answer whose words are the question's is compressed with the question
as a zstandard dictionary; one that needs hardly anything beyond it is a copy,
unless what is left over says something.  Language and refusal dictionaries and
the terminal-context model give the other defects.  A pair has one defect at
most, tested in the order empty, copy, refusal, language, truncated.

The refusal dictionaries hold no sentences but kinds of words: who speaks, what
negates, what answering and evidence are called.  A sentence declines if it
joins them, and counts near the beginning or end of an answer, where it speaks
about the answer itself.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terminal import CJK, Model, breaks_off, fit, passages, tokens
from ..session import broadcast_if_small, filled, materialize

# Labels before an answer.
LABEL = re.compile(
    r"^\s*(?:(?:final\s+)?answer|response|reply|a|antwort|respuesta|回答|答案|答复|答)\s*[:：]\s*", re.I
)
#: What stands where an answer is missing, folded to letters and digits.
PLACEHOLDERS = frozenset(
    "na none null nil nan tbd tba tbc todo pending empty missing undefined blank noanswer notavailable notapplicable "
    "unknown placeholder answer finalanswer response reply antwort respuesta keine keineangabe ka ninguno ninguna "
    "nulo sd nd sindatos 无 暂无 没有 空 待定 未知 不适用 回答 答案 答复 答 a".split()
)
# Who speaks, what negates, verbs that follow a negation, and what answers and evidence are called.
SPEAKER = {
    "en": r"\b(?:I|I'm|me|my|myself)\b|\b[Aa]s an? (?:AI|assistant|language model|chatbot|automated)\b|\bthis (?:assistant|model)\b",
    "de": r"\b(?:[Ii]ch|[Mm]ir|[Mm]ich|[Mm]eine[rnms]?|[Mm]ein)\b|\b[Aa]ls (?:KI|Assistent\w*|Sprachmodell)\b",
    "es": r"\b(?:[Yy]o|[Mm]e|[Mm]i|mí|puedo|podría|debo|dispongo|tengo|cuento|sé|estoy|soy|quiero|quisiera|prefiero|encuentro|logro|"
    r"lamento|siento|declino|rechazo|veo)\b|\b[Cc]omo (?:asistente|IA|modelo)\b",
    "zh": r"我|本人|本助手|助手|本模型|人工智能",
}
NEGATION = {
    "en": r"\b(?:not|no|none|nothing|neither|nor|cannot|\w+n't|unable|lack\w*|without|insufficient|impossible|beyond|outside|declin\w+|"
    r"refus\w+|hardly|too little)\b",
    "de": r"\b(?:nicht|kein\w*|nichts|niemals|ohne|fehl(?:t|en)|außerstande|unmöglich|verweiger\w+|lehne|ablehnen|unzureichend|zu wenig)\b",
    "es": r"\b(?:no|ni|nada|ningún|ninguna|ninguno|nunca|sin|imposible|incapaz|insuficientes?|declin\w+|rechaz\w+|fuera)\b",
    "zh": r"不能|不可|不便|不宜|不会|不得|不予|不足|不够|无法|没法|没有|无权|无从|拒绝|难以|未能|恕|缺少|缺乏",
}
VERB = {
    "en": r"\b(?:answer|respond|reply|help|assist|advise|comment|comply|say|tell|conclude|recommend|speculate|disclose|discuss|know)\b",
    "de": r"\b(?:antworten|beantworten|helfen|sagen|raten|beraten|empfehlen|beurteilen|mitteilen|weiterhelfen|äußern|weiß)\b",
    "es": r"\b(?:responder\w*|contestar\w*|ayudar\w*|decir\w*|opinar|aconsejar\w*|recomendar\w*|comentar|concluir|afirmar|sé)\b",
    "zh": r"回答|作答|答复|回复|解答|帮助|协助|判断|评论|说明|透露|告知|告诉",
}
REPLY = {
    "en": r"\b(?:answers?|reply|replies|responses?|statements?|advice|conclusions?|opinions?|recommendations?|guidance|assistance|requests?)\b",
    "de": r"\b(?:Antwort(?:en)?|Auskunft|Auskünfte|Aussagen?|Stellungnahme|Stellung|Rat|Ratschläge|Empfehlung(?:en)?|Meinung|Hilfe|Anfragen?)\b",
    "es": r"\b(?:respuestas?|consejos?|opinión|opiniones|conclusión|conclusiones|recomendación|recomendaciones|declaración|ayuda|solicitud)\b",
    "zh": r"回答|作答|答案|答复|回复|意见|建议|结论|看法|解答|请求",
}
EVIDENCE = {
    "en": r"\b(?:information|context|passages?|excerpts?|sources?|details?|knowledge|evidence|access|provided (?:text|data|material|documents?))\b",
    "de": r"\b(?:Information(?:en)?|Kontext|Textstellen?|Passagen?|Auszug|Auszügen?|Quellen?|Unterlagen|Angaben?|Wissen|Kenntnis(?:se)?|Zugriff)\b",
    "es": r"\b(?:información|contexto|pasajes?|fragmentos?|fuentes?|detalles|conocimientos?|documentación|material dado|datos suficientes|acceso)\b",
    "zh": r"信息|上下文|段落|资料|材料|依据|语境|原文|文档",
}
DECLINES = {
    # "I" is a capital, and so are German nouns.
    k: tuple(
        re.compile(d[k], 0 if k == "en" and d is SPEAKER or k == "de" and d in (REPLY, EVIDENCE) else re.I)
        for d in (SPEAKER, NEGATION, VERB, REPLY, EVIDENCE)
    )
    for k in SPEAKER
}
#: A condition says what holds in some case only.
CONDITION = re.compile(
    r"(?:^|[,;:]\s*)(?:if|when|whenever|where|should|unless|while|once|as long as|wenn|falls|sofern|sobald|solange|si|cuando|mientras)\s[^,;]*[,;]"
    r"|(?:如果|若|当|倘若|假如|一旦)[^，；]*[，；]",
    re.I,
)
ENDS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: Sentences from the beginning and the end of an answer that may decline it, and letters from a negation to its verb.
FIRST_SENTENCES, LAST_SENTENCES, REACH = 2, 3, 60
# Words that are frequent in one language only.
WORDS = {
    "en": "the is are was of to and which that must may by with after before when from until while has have be on at "
    "if where who what why how does this it an not only for been can will shall its than below above under between".split(),
    "de": "der die das und ist zu nach mit auf bei wird werden dem den ein eine einen nicht oder von zum zur wenn weil "
    "damit sich darf muss wie wer was warum auslöst höchstens dann danach bis aus liegt im am vom über unter vor".split(),
    "es": "el los las del y que se por con para una un al cuando cuál qué quién hay debe hasta más lo su desde sin "
    "sobre entre es antes después después está son queda pues hay a la de en".split(),
}
#: The function words of one language that no other list has.
ONLY = {k: frozenset(v) - frozenset(w for j, o in WORDS.items() if j != k for w in o) for k, v in WORDS.items()}
ALL = {k: frozenset(v) for k, v in WORDS.items()}
FUNCTION = frozenset(w for v in WORDS.values() for w in v)
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“]*“|«[^»]*»|「[^」]*」|'[^']{8,}'")
QUOTE = re.compile("[\"“„«「']")
CODES = re.compile(r"[A-Za-z]{1,4}-\d+|\d+(?:[.,]\d+)*\s*(?:[%°µμ]?[A-Za-z]{1,4}(?:/[A-Za-z]+)?\b)?")
HAN = re.compile(f"[{CJK}]")
UNIT = re.compile(rf"[{CJK}]|(?:(?![{CJK}])[^\W_])+")
NEGATION_ZH = re.compile(NEGATION["zh"])
# The words that the negations of the other languages hold one of.
NEGATIVE = frozenset(
    "not no none nothing neither nor cannot t unable lack lacks lacking lacked without insufficient impossible beyond outside "
    "decline declines declined declining refuse refuses refused refusing hardly little "
    "nicht kein keine keinen keiner keinem keines keinerlei nichts niemals ohne fehlt fehlen außerstande unmöglich verweigere verweigern "
    "verweigert lehne ablehnen unzureichend wenig "
    "ni nada ningún ninguna ninguno nunca sin imposible incapaz insuficiente insuficientes declino declinar declinamos rechazo "
    "rechazar rechazamos fuera".split()
)
#: Least share of the question in a copy, and most bytes of its own.
COPY_LEAST, COPY_EXCESS = 0.7, 0.2
#: Fewer letters hold no match that compression could find: they must be equal.
SHORT = 8
# Words besides the question's that say nothing.
SAYS_NOTHING = FUNCTION | frozenset(
    "you your asked ask asking question i my answer answers know want wonder say says here question's about "
    "du sie ihre deine frage gefragt lautet lautete fragst fragen antwort sie wollten wissen "
    "usted tu su pregunta preguntó preguntaste preguntas respuesta saber quiere "
    "您 你 请 问 题 的 是 吗 呢 了 吧 答 说 想 知 道".split()
)
LATIN = re.compile(r"[^\W\d_]+")
INVISIBLE = re.compile(r"[​-‏ -‮⁠-⁤﻿­]")


def folded(text: str) -> str:
    """Letters and digits only, NFKC, lower case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


@lru_cache(64)
def unlabelled(answer: str) -> str:
    """Answer without markup, entities, invisible characters and leading labels."""
    text = re.sub(r"<[^<>]*>", " ", answer) if "<" in answer else answer
    text = html.unescape(text) if "&" in text else text
    text = INVISIBLE.sub("", text)
    while True:
        shorter = LABEL.sub("", text, count=1)
        if shorter == text:
            return text
        text = shorter


def is_empty(answer: str | None) -> bool:
    """No text, or only invisible characters, marks, a label or a placeholder.

    A single letter or digit is taken as a bare value, unless it is a label."""
    if answer is None:
        return True
    rest = "".join(units(unlabelled(answer)))
    return not rest or rest in PLACEHOLDERS


def copy_excess(question: str, answer: str) -> float:
    """Bytes that the answer needs beyond the question itself when both are
    compressed with the question as a dictionary, as a share of what it needs
    without: near 0 for a copy, near 1 for an answer that says something else."""
    import zstandard

    q, a = question.encode("utf-8", "replace"), answer.encode("utf-8", "replace")
    plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=known, **plain)
    itself = len(packer.compress(q))
    alone = len(zstandard.ZstdCompressor(level=3, **plain).compress(a))
    return (len(packer.compress(a)) - itself) / max(1, alone - itself)


@lru_cache(64)
def units(text: str) -> list[str]:
    """Words, and single characters of scripts without spaces.  End to end they
    are the folded text."""
    return UNIT.findall(unicodedata.normalize("NFKC", text).lower())


def is_copy(question: str | None, answer: str) -> bool:
    """The answer says nothing but the question, once or several times.

    It must hold nearly all of the question's words and need hardly any bytes
    beyond the question; what it has besides may be a label, words about asking
    or function words, but no name, number, yes or no."""
    if not question:
        return False
    asked, said = units(question), units(unlabelled(answer))
    size, own = sum(map(len, asked)), sum(map(len, said))
    if not size or own < COPY_LEAST * size:
        return False
    if size < SHORT:
        return "".join(said) == "".join(asked) * (own // size)
    content, left = set(asked) - FUNCTION, Counter(said)
    for w in asked:
        left[w] -= -(-len(said) // max(1, len(asked)))
    if any(n > 0 and w not in SAYS_NOTHING for w, n in left.items()):
        return False
    if sum(w in set(said) for w in content) < COPY_LEAST * len(content):
        return False
    return copy_excess(" ".join(asked), " ".join(said)) <= COPY_EXCESS


def declines(text: str) -> bool:
    """A sentence at the beginning or end declines to answer: the speaker, a
    negation and a word for answering or evidence, or without a speaker a
    negation, evidence and an answer."""
    words = units(text)
    if NEGATIVE.isdisjoint(words) and not NEGATION_ZH.search(text):
        return False
    sentences = [x for x in ENDS.split(QUOTED.sub(" ", text)) if x and x.strip()]
    n = len(sentences)
    for i, sentence in enumerate(sentences):
        if FIRST_SENTENCES <= i < n - LAST_SENTENCES:
            continue
        rest = CONDITION.sub(" ", sentence.strip())
        for lang in ("zh",) if HAN.search(rest) else ("en", "de", "es"):
            speaker, negation, verb, reply, evidence = DECLINES[lang]
            no = negation.search(rest)
            if not no:
                continue
            if speaker.search(rest):
                if reply.search(rest) or evidence.search(rest) or verb.search(rest, no.end(), no.end() + REACH):
                    return True
            elif evidence.search(rest) and reply.search(rest):
                return True
    return False


def language(text: str) -> tuple[str | None, int]:
    """Language of a text and how many words or characters speak for it, without
    quoted passages, codes, numbers and units.  None if too little is left."""
    text = CODES.sub(" ", QUOTED.sub(" ", text) if QUOTE.search(text) else text)
    han = len(HAN.findall(text)) if not text.isascii() else 0
    words = LATIN.findall(HAN.sub(" ", text.lower()) if han else text.lower())
    if han >= 4 and han >= 2 * len(words):
        return "zh", han
    votes = {k: sum(map(s.__contains__, words)) + 0.01 * sum(map(ALL[k].__contains__, words)) for k, s in ONLY.items()}
    first, second = sorted(votes, key=votes.get, reverse=True)[:2]
    if votes[first] >= 1 and votes[first] >= 1.5 * votes[second] + 0.5:
        return first, len(words)
    return None, len(words)


def other_language(question: str | None, answer: str) -> bool:
    """Answer and question are whole passages in different languages.  Bare
    values and names have too few words to count."""
    if not question:
        return False
    a, size = language(unlabelled(answer))
    if a is None or size < (8 if a == "zh" else 6):
        return False
    q, _ = language(question)
    return q is not None and q != a


def defect(question: str | None, answer: str | None, model: Model) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    text = unlabelled(answer)
    if declines(text):
        return "refusal"
    if other_language(question, answer):
        return "language"
    how = breaks_off(answer, model)
    if how is None or (how == "sentence" and is_bare(text)):
        return None
    return "truncated"


def is_bare(text: str) -> bool:
    """A short answer such as a name, a value or a phrase of a few words: the
    contexts of whole sentences say nothing about it.  It must not end in a
    function word."""
    t = tokens(text)
    if len(passages(text)) != 1 or not all(x[0].isalnum() or x[0] == "@" for x in t):
        return False
    few = len(t) <= (8 if t[-1][0] == "@" or HAN.search(text) else 4)
    return few and t[-1] not in FUNCTION


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """Adds defect to pairs (pair_table, pair_id, question, answer); null where
    the pair is sound.

    A missing answer is empty; a missing question only rules out copy and
    language.  Repeated rows of a pair count once (the smallest answer wins where
    they differ), so every pair has one row.  The terminal contexts are counted
    over all pairs; every pair is judged on its whole text.
    """
    # Only keys are shuffled to find those with more than one row.
    named = ["pair_table", "pair_id"]
    several = materialize(pairs.groupBy(*named).agg(F.count("*").alias("n")).where("n > 1").select(*named))
    several = broadcast_if_small(several, 100_000)
    first = F.min(F.struct("answer", "question")).alias("p")
    merged = pairs.join(several, named, "left_semi").groupBy(*named).agg(first).select(*named, "p.question", "p.answer")
    cols = [*named, "question", "answer"]
    one = pairs.where("pair_table is null or pair_id is null").groupBy(*named).agg(first).select(*named, "p.question", "p.answer")
    one = one.unionByName(pairs.dropna(subset=named).join(several, named, "left_anti").select(*cols)).unionByName(merged)
    text = F.concat_ws("\n", "question", "answer")
    model = pairs.sparkSession.sparkContext.broadcast(fit(pairs.select(text.alias("t")), "t"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            found = [defect(q, a, m) for q, a in zip(pdf["question"], pdf["answer"])]
            yield pdf.assign(defect=pd.Series(found, dtype=object, index=pdf.index))

    schema = "pair_table string, pair_id string, question string, answer string, defect string"
    return one.mapInPandas(filled(judge), schema)
