"""Problem 2: answers that are empty, cut off, refusals, copies of their question or in another language.

Ordered rules, each on its own, so that an answer can show several defects. Whether an open end is abrupt is
judged by the table itself: an end is whole if the table's different answers close it at least half as often as
they leave it open, words that are names and numbers apart. Neither the size of the table nor answers that are
given many times change that ratio.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.language import Profiles, Sentences
from corpusloom.session import stage

#: In the order in which one is chosen where an answer has several.
DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: Words that stand for an answer that isn't there, and labels.
PLACEHOLDERS = frozenset("na n/a n.a nan none null nil tbd tba todo undefined empty noanswer noresponse blank missing placeholder error pending notavailable noanswergiven norespuesta sinrespuesta keineantwort pasderéponse".split())
LABELS = r"(?:final answer|answer|response|output|result|antwort|réponse|reponse|respuesta|risposta|resposta|question|frage|pregunta|ans|q|a)"
#: Leads, and phrases of declining in the languages of the corpus.
LEADS = r"(?:(?:i'?m |i am |we are )?(?:so |very |truly )?(?:sorry|afraid)|i apologi[sz]e|my apologies|unfortunately|regrettably|es tut mir leid|leider|lo siento|lamento|lamentablemente|desafortunadamente|je suis désolée?|désolée?|malheureusement|mi dispiace|purtroppo|sinto muito|infelizmente|het spijt me|helaas|przykro mi|niestety|к сожалению|извините|as an? (?:assistant|ai|language model))"
REFUSALS = [
    r"^\W*(?:failed|unable) to (?:generate|produce|find|give)\b",
    r"\bi(?: a|')?m (?:not able|unable|not in a position) to\b", r"\b(?:i|we) (?:can ?not|can'?t|could ?n'?t|could not|am not able to) (?:\w+ ){0,2}?(?:determine|answer|tell|say|provide|help|find|identify|confirm|verify|give|assist|comment|speculate|establish)",
    r"\b(?:i|we) (?:do not|don'?t) (?:know|have (?:enough|any|sufficient|that|the|access))", r"\b(?:i|we)(?:'d| would) rather not\b", r"\bi (?:must|have to|need to) (?:decline|refuse|abstain|pass)\b", r"\bi (?:won'?t|will not) (?:guess|speculate|answer)", r"\b(?:decline|refuse) to (?:answer|say|comment|speculate)",
    r"\b(?:it is|it'?s) (?:not possible|impossible|unclear|not clear) (?:to (?:tell|say|determine|know|answer|identify)|from)", r"\b(?:documents?|context|passages?|excerpts?|corpus|texts?|sources?|material|information)\b[^.!?]{0,40}\b(?:do(?:es)? not|do(?:es)?n'?t|did not) (?:\w+ )?(?:contain|mention|provide|say|state|include|specify|allow|give|cover|list)",
    r"\b(?:is|are) silent on\b", r"\bno (?:passage|document|excerpt|source|information|mention|evidence|record|data)\b[^.!?]{0,60}\b(?:mentions?|contains?|is given|available|provided|found|about|states?)\b", r"\bnothing in the\b[^.!?]{0,60}\b(?:lets|allows|tells|identif|mentions|says|states)", r"\b(?:there is|there'?s|there are)(?: not|n'?t) (?:enough|sufficient|any)\b[^.!?]{0,20}\b(?:information|data|evidence|context|detail)", r"\bnot enough (?:information|context|data)\b", r"\binsufficient (?:information|context|data)\b",
    r"\boutside (?:of )?(?:what|my|the scope)\b", r"\bno answer (?:can be|is) given\b", r"\bcannot be (?:determined|answered|established)\b", r"\bunable to (?:help|answer|determine|provide|find|tell)\b(?! that)",
    r"\b(?:ich|wir) (?:kann|können|konnte)\b[^.!?]{0,60}\b(?:nicht|keine|nichts)\b", r"\bdazu kann ich\b", r"\bich weiß (?:es |das )?nicht\b", r"\b(?:lässt|läßt) sich\b[^.!?]{0,60}\bnicht\b[^.!?]{0,20}\b(?:bestimmen|sagen|beantworten|ermitteln|feststellen|entnehmen)", r"\b(?:dokumente|kontext|texte|auszüge|unterlagen)\b[^.!?]{0,40}\b(?:keine|nicht|nichts)\b[^.!?]{0,30}(?:angaben|information|hinweise|auskunft|erwähn|enthalten|hervor)?", r"\b(?:möchte|will) (?:ich )?(?:lieber )?nicht (?:raten|spekulieren|mutmaßen)", r"\bich möchte\b[^.!?]{0,40}\bnicht (?:raten|spekulieren)", r"\bkeine (?:angaben|antwort|informationen)\b[^.!?]{0,30}\b(?:möglich|vorhanden|gefunden|enthalten)?\b(?=[^.!?]{0,40}(?:wettbewerb|frage|möglich))",
    r"\bno (?:puedo|podemos|es posible|sé|lo sé|dispongo|tengo (?:suficiente|información)|encuentro|hay (?:suficiente|información|datos))", r"\bno (?:contienen?|mencionan?|permiten?|ofrecen?|incluyen?|proporcionan?|aparece)\b[^.!?]{0,40}\b(?:información|datos|saber|responder|determinar|prueba|respuesta)", r"\bprefiero no (?:adivinar|especular|responder|conjeturar)", r"\bme es imposible\b", r"\bes imposible (?:saber|determinar|decir)",
    r"\bje ne (?:peux|sais|puis|suis pas en mesure|dispose|trouve)\b", r"\bne (?:contien\w+|permet\w*|mentionn\w+|précis\w+|donn\w+|fourni\w+|dis\w+) (?:pas|aucune?)\b", r"\b(?:il )?m'est impossible\b", r"\bil est impossible de\b", r"\bimpossible de (?:le )?(?:dire|répondre|déterminer|savoir)", r"\bje préfère ne pas\b", r"\bpas (?:assez|suffisamment) d'information", r"\baucun(?:e)? (?:information|passage|document|extrait|réponse)\b[^.!?]{0,50}\b(?:ne|disponible|n')",
    r"\bnon (?:posso|so\b|sono in grado|è possibile|ho (?:abbastanza|informazioni))", r"\bnon (?:contengono|contiene|permette|consente)\b", r"\bpreferisco non\b", r"\bnão (?:posso|sei\b|consigo|é possível|tenho (?:informações|como))", r"\bnão (?:contêm|contém|permite)\b", r"\bprefiro não\b", r"\bik (?:kan|weet)\b[^.!?]{0,50}\bniet\b", r"\bbevatten? geen\b", r"\bnie (?:mogę|wiem|jestem w stanie|da się|można)\b", r"\bnie zawiera", r"\bне (?:могу|знаю|удалось|содержит|содержат)\b", r"\bневозможно\b",
]
#: What shows that an answer follows all the same.
GIVEN = r"\b(?:but|however|nevertheless|at first|aber|jedoch|mais|cependant|pero|sin embargo)\b[^.!?]*\b(?:won|winner was|gold (?:was|went)|awarded|gewann|gagné|remporté|ganó)\b|\b(?:won|gewann|remporté|ganó) (?:the |die |la |el |l')?(?:gold|goldmedaille|médaille|medalla|oro)\b|\bgold was awarded\b"
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS), re.I)
_GIVEN = re.compile(GIVEN, re.I)
_LEAD = re.compile(rf"^\W*{LEADS}\b", re.I)
_LABEL = re.compile(rf"^\W*{LABELS}\W*(?=[:：])[:：]\W*", re.I)
#: Event names as they stand in questions and answers, which count for no language.
_EVENTS = re.compile(r"(?:\b\w+(?: \w+)? (?:at|in) the \d{4} [\w'’-]+(?: [\w'’-]+)? Games\b(?: ?[–-] ?)?)|\b(?:Men|Women)['’]s (?:[\w-]+ ?){1,4}|\bMixed \w+", re.U)
_CLOSERS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_OPEN_WORDS = re.compile(r"[,;:–—(\[{«“/&+-]$|[^\W\d]['’]$")
#: Least evidence (sum of log odds) for another language, least words in it, and the least evidence a word must have on average.
LANGUAGE_MARGIN, LANGUAGE_WORDS, MARGIN_A_WORD = 9.0, 3, 0.9
TAIL = 4
#: An end is whole if it is closed at least so often for each time it is open.
CLOSED_PART = 0.5


def bare(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(c for c in text.lower() if c.isalnum())


def visible(text: str) -> str:
    """Without punctuation, marks, blanks and invisible characters."""
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    seen = visible(answer)
    if not seen:
        return True
    rest = re.sub(rf"^\W*{LABELS}\W*$", "", answer.strip(), flags=re.I) if re.search(r"[:：*]\W*$", answer) else answer
    rest = _LABEL.sub("", rest) if _LABEL.match(rest) else rest
    return not visible(rest) or visible(rest).lower() in {bare(p) for p in PLACEHOLDERS}


def near(a: str, b: str) -> bool:
    """Nearly the same letters: at most an eighth of the shorter one's pairs of neighbours is lacking in the other."""
    if not a or not b or min(len(a), len(b)) < 0.7 * max(len(a), len(b)):
        return False
    left: dict[str, int] = {}
    for k in range(len(a) - 1):
        left[a[k : k + 2]] = left.get(a[k : k + 2], 0) + 1
    shared = 0
    for k in range(len(b) - 1):
        if left.get(b[k : k + 2], 0):
            left[b[k : k + 2]] -= 1
            shared += 1
    return shared >= 0.87 * (max(len(a), len(b)) - 1)


def without_question(answer: str, question: str) -> str:
    """What is left of an answer after a copy of its question at the start, and after labels."""
    rest = answer.strip()
    for _ in range(4):
        rest = _LABEL.sub("", rest)
        want, k, at = bare(question), 0, 0
        while at < len(rest) and k < len(want):
            c = rest[at].lower()
            if c.isalnum():
                if c != want[k]:
                    break
                k += 1
            at += 1
        if k < len(want) or not want:
            break
        rest = rest[at:].lstrip(" \t\n\r?¿!.:-–\"'»”)*")
    return rest


def copies(answer: str, question: str | None) -> bool:
    if not question or not bare(question):
        return False
    rest = without_question(answer, question)
    if not visible(rest) and bare(answer):
        return True
    rest = re.sub(rf"\n\W*{LABELS}\W*:\W*$", "", rest.strip(), flags=re.I)
    want, has = bare(question), bare(rest)
    if not has:
        return True
    half = len(has) // 2
    return near(has, want) or (len(has) >= 0.6 * len(want) and want.startswith(has)) or (near(has[:half], want) and near(has[half:], want))


def refuses(answer: str) -> bool:
    """A phrase of declining, and no answer: nothing won, and no number or further sentence but advice."""
    text = re.sub(r"\s+", " ", answer).replace("’", "'")
    hit = _REFUSAL.search(text)
    if not hit or _GIVEN.search(re.sub(r"\bwho (?:won|took|received)\b", "", text)):
        return False
    # in what precedes it there is only a lead
    head = text[: hit.start()]
    sentence = re.split(r"(?<=[.!?])\s", head)
    if len(sentence) > 2 or len(head) > 120:
        return False
    lead = _LEAD.match(head) is not None
    names = re.findall(r"(?<!^)(?<![.!?:] )\b[A-ZÀ-Ý][\w'-]+ [A-ZÀ-Ý][\w'-]+", head)
    return lead or not names


def languages(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each text for each language, and its number of words."""
    sentences = Sentences(texts)
    evidence = np.zeros((len(texts), max(1, len(profiles.languages))))
    words = np.zeros(len(texts), dtype=np.int64)
    if len(sentences.starts):
        np.add.at(evidence, sentences.owner, profiles.evidence(sentences))
        np.add.at(words, sentences.owner, np.where(sentences.prose, sentences.words, 0))
    return evidence, words


def running(text: str) -> str:
    """The words that tell a language: no event names, no names of two or more capitalised words, no numbers, no titles of works."""
    text = _EVENTS.sub(" ", text.replace("’", "'"))
    text = re.sub(r"\b[A-ZÀ-Ý][\w'-]+(?:[ -](?:(?:van|von|de|of) )?[A-ZÀ-Ý][\w'-]+)+", " ", text)
    text = re.sub(r"(?<=[a-zà-ÿ,] )[A-ZÀ-Ý][\w'-]{6,}", " ", text)
    text = re.sub(r"[«“\"„][^»”\"“]*[»”\"“]", " ", text)
    return re.sub(r"\d+(?:\.\d+)?|[|]", " ", text)


def unclosed(answer: str) -> bool:
    """A bracket, quotation, emphasis or code fence is opened and not closed, or a table's last row is short."""
    stack = []
    for c in answer:
        if c in "([{«“":
            stack.append(c)
        elif c in _CLOSERS and stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
    if stack and not (stack == ["“"] and "„" in answer):
        return True
    if answer.count('"') % 2 or answer.count("```") % 2 or answer.replace("```", "").count("**") % 2 or answer.count("„") > answer.count("“") + answer.count("”"):
        return True
    rows = [x.strip() for x in answer.split("\n") if x.strip().startswith("|") or " | " in x]
    if len(rows) > 1 and rows[-1].count("|") < max(r.count("|") for r in rows[:-1]):
        return True
    # a list's mark without an item, a label without a value
    return re.search(r"\n\s*(?:[-*•]|\d{1,2}[.)])\s*$|[:：][*_\s]*$", answer) is not None


#: Words between the parts of names and places, and units.
_BETWEEN = frozenset("of de du des da di del della van von der den af aus from silver bronze gold plata bronce argent silber seconds secondes segundos sekunden secondi segundi metres meters mètres metros meter metern metri points puntos punkte punkten punti pontos minutes minuten minutos nations naciones nationen".split())


def names_only(text: str) -> bool:
    """Nothing but names, numbers and events, such as is a whole answer without being a sentence."""
    rest = re.findall(r"\b[^\W\d_][\w'-]*", _EVENTS.sub(" ", text.replace("’", "'")))
    return sum(w[0].islower() and w not in _BETWEEN for w in rest) == 0


_TOKEN = re.compile(r"[^\W\d]+(?:['’-][^\W\d]+)*['’]?|\d+(?:[.,:]\d+)*(?:st|nd|rd|th|e|er|re|\.º|º|ª)?|[^\w\s]")


def shape(sentence: str) -> list[str]:
    """A sentence's tokens with ``#`` for numbers and ``N`` for runs of capitalised words after the first."""
    out: list[str] = []
    for k, token in enumerate(_TOKEN.findall(sentence)):
        if token[0].isdigit():
            token = "#"
        elif token[0].isupper() and (k or len(token) > 1):
            token = "N" if k else "^" + token.lower() if len(token) <= 3 or sentence[len(token) : len(token) + 1] == " " and sentence[len(token) + 1 : len(token) + 2].islower() else "N"
        else:
            token = token.lower()
        if not (token == "N" and out and out[-1] == "N"):
            out.append(token)
    return out


def tail(sentence: str) -> str:
    """The last tokens of a sentence's shape, without its closing mark."""
    tokens = shape(sentence.strip().rstrip(".!?…\"'»”* "))
    return " ".join((["^"] if len(tokens) < TAIL else []) + tokens[-TAIL:])


def sentences_of(answer: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[\"'«“(¿¡]?[A-ZÀ-ÝА-Я0-9])|\n+", answer.strip()) if s.strip()]


def is_open(answer: str) -> bool:
    """No mark closes it."""
    return not re.search(r"[.!?。][\"'”’»)\]*}\s]*$|[)\]}|]\s*$|```\s*$", answer)


def find_defects(df: DataFrame, profiles: Profiles, key: str = "pred_id", question: str = "question", answer: str = "predicted_answer") -> DataFrame:
    """``key`` and ``defect`` of every defect that an answer shows, distinct.

    An answer to a null or blank question can be empty, a refusal or truncated only. Rows logged again count
    once; if a key has several answers, the defects of all of them are given. Null keys stay. Empty tables
    give no rows. Answers are read whole; language is judged by ``profiles``.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a")).distinct()
    kind = df.schema[key].dataType.simpleString()

    def judge(frames):
        known = shared.value
        for frame in frames:
            answers = [None if x is None or isinstance(x, float) else x for x in frame["a"]]
            questions = [None if x is None or isinstance(x, float) else x for x in frame["q"]]
            rest = [without_question(a, q) if a and q else a or "" for a, q in zip(answers, questions)]
            asked, _ = languages([running(q or "") for q in questions], known)
            told, words = languages([running(a) for a in rest], known)
            lower = [len(re.findall(r"\b[^\W\d_]+", "".join(c if not c.isupper() else " 0" for c in running(a)))) for a in rest]
            out = []
            for k, (a, q) in enumerate(zip(answers, questions)):
                found, last = [], None
                if is_empty(a):
                    found.append("empty")
                else:
                    if copies(a, q):
                        found.append("copies_question")
                    if refuses(rest[k]):
                        found.append("refusal")
                    if known.languages and q and visible(q):
                        own, best = int(asked[k].argmax()), int(told[k].argmax())
                        margin = told[k][best] - told[k][own]
                        if best != own and lower[k] >= LANGUAGE_WORDS and margin >= max(LANGUAGE_MARGIN, MARGIN_A_WORD * words[k]):
                            found.append("other_language")
                    text = rest[k].strip()
                    if unclosed(a) or _OPEN_WORDS.search(text):
                        found.append("truncated")
                    elif text and "refusal" not in found and is_open(text) and not names_only(text):
                        parts = sentences_of(text)
                        last = tail(parts[-1]) if parts else None
                out.append((frame["key"].iloc[k], found, last))
            yield pd.DataFrame(out, columns=["key", "found", "last"])

    def ends(frames):
        for frame in frames:
            out = []
            for a in frame["a"]:
                if isinstance(a, str):
                    out += [(tail(s), 0 if is_open(s) or unclosed(s) else 1) for s in sentences_of(a)]
            yield pd.DataFrame(out, columns=["last", "closed"])

    judged = stage(rows.mapInPandas(judge, f"key {kind}, found array<string>, last string"), "judged")
    # how often the different answers of the table close an end and leave it open
    ends_of = rows.select("a").distinct().mapInPandas(ends, "last string, closed int").groupBy("last").agg(F.sum("closed").alias("closed"), F.count("*").alias("n"))
    whole = ends_of.where((F.col("closed") > 0) & (F.col("closed") >= CLOSED_PART * (F.col("n") - F.col("closed")))).select("last")
    # only open ends are looked up; answers without one don't come into the join as so many nulls
    abrupt = judged.where("last is not null").join(whole, "last", "left_anti").select(F.col("key").alias(key), F.lit("truncated").alias("defect"))
    return judged.select(F.col("key").alias(key), F.explode("found").alias("defect")).unionByName(abrupt).distinct()


def first_defect(defects: DataFrame, key: str = "pred_id") -> DataFrame:
    """One defect for each key, the first in the order of DEFECTS."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return defects.groupBy(key).agg(F.min_by("defect", rank).alias("defect"))
