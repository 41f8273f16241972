"""Broken prompt and response pairs: a pushdown parse and corpus sentence ends for truncation, greedy string tiling for
copies, a grammar of clauses for refusals, character n-gram models and scripts for the language."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import WORD, words
from wakeline.storage import keep

#: answers that say nothing, without punctuation: fixed values
PLACEHOLDERS = {"", "na", "n a", "none", "null", "nil", "nan", "undefined", "todo", "tbd", "empty", "unknown", "no answer", "no response", "not available", "not applicable", "placeholder", "missing", "lorem ipsum", "string", "text", "answer", "k a", "sin respuesta", "keine antwort"}

def script_of(text: str) -> str:
    """The script of most of the text's letters, by their Unicode names ('' without letters)."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else ""
    n: dict[str, int] = {}
    for ch, k in Counter(text).items():
        if ch.isalpha():
            name = unicodedata.name(ch, "?").split()[0]
            n[name] = n.get(name, 0) + k
    return max(n, key=lambda x: (n[x], x)) if n else ""


_PLAIN = re.compile(r"(?<![\w'’])[^\W\d_]+")


def plain_words(text: str) -> list[str]:
    """Words that begin in lower case: names, which belong to no language, seldom do."""
    return [w for w in _PLAIN.findall(text) if w[0].islower() or not (w[0].isupper() or w[0].islower())]


def _contexts(word: str) -> list[tuple[str, str]]:
    """(context and character, context alone) for each character of a word and its end, each after up to three before it."""
    padded = f"^^^{word}$"
    return [(padded[i - c : i + 1], padded[i - c : i] + "\t") for i in range(3, len(padded)) for c in range(4)]


class Languages:
    """Character n-gram models of the languages of labelled texts.

    A word's likelihood in a language is that of its characters, each after the three before it, interpolated with shorter contexts. fit is the
    mean log-likelihood of a character; a text whose fit in a language is far under what the texts trained on reach is in another language, known or not."""

    def __init__(self, names: list[str] | dict, grams: dict[str, np.ndarray] | None = None):
        self.names, self.grams = list(names), grams or {}
        self.known: dict[str, np.ndarray] = {}
        self.said: dict[str, tuple] = {}
        self.none = np.zeros(len(self.names))
        self.usual = np.full(len(self.names), -1e9)

    def word(self, w: str) -> np.ndarray:
        """Log-likelihood of a word and its end in each language."""
        got = self.known.get(w)
        if got is None:
            got = np.zeros(len(self.names))
            for i, (one, all_) in enumerate(_contexts(w)):
                p = (self.grams.get(one, self.none) + 4 * (p if i % 4 else 1e-4)) / (self.grams.get(all_, self.none) + 4)
                if i % 4 == 3:
                    got += np.log(p)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = got
        return got

    def weigh(self, text: str) -> tuple[np.ndarray, int, int]:
        """(log-likelihood in each language, characters, words) of the text's plain words."""
        ws = [w.lower() for w in plain_words(text)]
        return (sum((self.word(w) for w in ws), np.zeros(len(self.names))), sum(len(w) + 1 for w in ws), len(ws))

    def other(self, said: str, answer: str, lead: float = 8.0, short: float = 0.5, least: int = 4) -> bool:
        """The answer is in another language than what was said: its letters are of another script, another language is likelier by `lead`, or its fit is
        `short` under the least that the texts trained on have in the language of what was said (texts of `least` words or more)."""
        if said not in self.said:
            if len(self.said) > 10_000:
                self.said.clear()
            self.said[said] = (*self.weigh(said)[:2], script_of(" ".join(plain_words(said))))
        want, n, script = self.said[said]
        if not n or not answer:
            return False
        if (script != "LATIN" or not answer.isascii()) and script_of(" ".join(plain_words(answer))) not in ("", script):
            return True
        if not len(want):
            return False
        k = int(want.argmax())
        have, m, words_ = self.weigh(answer)
        if words_ < least:
            return False
        known = want[k] / n >= self.usual[k] - short  # else what was said is in none of the languages, and no fit can be asked for
        return bool(have.max() - have[k] > lead or known and have[k] / m < self.usual[k] - short)


def spoken(prompt: str | None) -> tuple[str, list[str]]:
    """(what a prompt says, its listed lines): titles stand in the lists."""
    lines = [x for x in (prompt or "").splitlines() if x.strip()]
    listed = [x for x in lines if re.match(r"\s*(?:\d+[.)]|[-*•])\s", x)]
    return " ".join(x for x in lines if x not in listed), listed


class _Bags:
    """Plain words of many texts as numbers, with each word's log-likelihoods in models and what texts of each label hold of it."""

    def __init__(self, labels: int, *models: Callable[[str], np.ndarray]):
        self.labels, self.models = labels, models
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.said = [np.zeros((0, self.labels)) for _ in self.models]
        self.length = np.zeros(0, np.int64)
        self.held = np.zeros((3, 0), np.int64)

    def take(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the texts' words as numbers, where each text begins and the last ends)."""
        before, get, got = len(self.known), self.known, []
        size = [0]
        for t in texts:
            ws = plain_words(t)
            got += [get.setdefault(w, len(get)) for w in map(str.lower, ws)]
            size.append(len(ws))
        if new := list(get)[before:]:
            self.said = [np.concatenate([x, np.array([f(w) for w in new])]) for x, f in zip(self.said, self.models, strict=True)]
            self.length = np.concatenate([self.length, [len(w) + 1 for w in new]])
        return np.array(got, np.int64), np.cumsum(size)

    def sums(self, values: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[ids], axis=0)])
        return c[at[1:]] - c[at[:-1]]

    def likeliest(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The label of each text by the first model; -1 without words."""
        return np.where(np.diff(at) > 0, self.sums(self.said[0], ids, at).argmax(axis=1), -1)

    def tally(self, ids: np.ndarray, at: np.ndarray, label: np.ndarray, plain: bool) -> None:
        size = np.diff(at)
        of, text = np.repeat(label, size), np.repeat(np.arange(len(size)), size)
        some = of >= 0
        if self.held.shape[1] < len(self.known) * self.labels:
            self.held = np.concatenate([self.held, np.zeros((3, 2 * len(self.known) * self.labels - self.held.shape[1]), np.int64)], axis=1)
        code = (ids * self.labels + of)[some]
        np.add.at(self.held[1 if plain else 0], code, 1)
        if plain and len(code):
            each = np.unique(text[some] * (len(self.known) * self.labels) + code) % (len(self.known) * self.labels)
            np.add.at(self.held[2], each, 1)

    def counts(self) -> pa.RecordBatch:
        """(word, l, n, m, h): in texts with label l a word's places in labelled texts and in others, and how many others hold it."""
        at = np.flatnonzero(self.held.any(axis=0))
        out = [pa.array(np.array(list(self.known), object)[at // self.labels] if len(at) else [], pa.string()), pa.array((at % self.labels).astype(np.int32)), *(pa.array(x[at]) for x in self.held)]
        return pa.record_batch(out, names=["word", "l", "n", "m", "h"])


#: of a word's 1 + ln(places), so that sums do not depend on their order
_UNIT = 1 << 20


def _half(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & 1


def _weights(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What words (places by label) weigh under each label: a word much rarer under one label than under another came by a wrong label."""
    share = n / np.maximum(total, 1)
    return np.where((n > 0) & (share > 0.2 * share.max(axis=1, keepdims=True)), np.rint(_UNIT * (1 + np.log(np.maximum(n, 1)))), 0).astype(np.int64)


def _gram_sums(words: list[str], n: np.ndarray, totals: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(n-grams, their weights [n-gram, model, label]) by all words and by the words of either half; totals by half."""
    half = np.array([_half(w) for w in words], np.int64)
    each = np.stack([_weights(n, totals.sum(axis=0)), *(np.where(half[:, None] == h, _weights(n, totals[h]), 0) for h in (0, 1))], axis=1)
    number: dict[str, int] = {}
    ids, row = [], []
    for i, w in enumerate(words):
        if each[i].any():
            got = [number.setdefault(g, len(number)) for x in _contexts(w) for g in x]
            ids += got
            row += [i] * len(got)
    out = np.zeros((len(number), *each.shape[1:]), np.int64)
    for x in range(0, len(ids), 100_000):
        np.add.at(out, ids[x : x + 100_000], each[row[x : x + 100_000]])
    return list(number), out


def _models(names: list[str], grams: list[str], weights: np.ndarray) -> list[Languages]:
    """The model of all words and those of either half."""
    w = weights / _UNIT
    return [Languages(names, {g: w[i, k] for i, g in enumerate(grams) if weights[i, k].any()}) for k in range(3)]


def _fits(bags: _Bags, texts: list[str]) -> np.ndarray:
    """(label, fit by the model of all, fit by the models of the other half of the words) of each text of eight words or more; bags with the models labels come
    from, of all, and of the other half."""
    ids, at = bags.take(texts)
    label, n = bags.likeliest(ids, at), bags.sums(bags.length, ids, at)
    use = np.flatnonzero(np.diff(at) >= 8)
    return np.stack([label[use], *(bags.sums(bags.said[k], ids, at)[use, label[use]] / n[use] for k in (1, 2))], axis=1)


def _least(fits: np.ndarray, n: np.ndarray) -> float:
    """The fit a hundredth of the texts don't reach, of fits that come n times each."""
    order = np.argsort(fits)
    upto, place = np.cumsum(n[order]), 0.01 * (n.sum() - 1)
    low, high = (fits[order][np.searchsorted(upto, math.floor(place) + k, "right").clip(max=len(fits) - 1)] for k in (0, 1))
    return float(low + (high - low) * (place - math.floor(place)))


def _other_half(halves: list[Languages]) -> Callable[[str], np.ndarray]:
    return lambda w: halves[1 - _half(w)].word(w)


def _enough(n: dict[str, int]) -> list[str]:
    """Labels of half a percent of the texts or more; the others are taken for slips."""
    return sorted(x for x, k in n.items() if k >= max(5, sum(n.values()) // 200))


def learn_languages(labelled: DataFrame, rows: DataFrame, most: int = 200_000) -> Languages:
    """train_languages over all labelled texts (text, lang) and all pairs (p, a), whatever their number: words are counted in the tasks, which hand on their counts after
    every `most` words, and only sums by n-gram reach the driver. Labels are normalised (case, blanks, what follows a hyphen). Without labelled texts there are no languages."""
    label = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    named = labelled.select(label.alias("l"), F.col("text").alias("t")).filter("l <> '' and t is not null")
    names = _enough({r["l"]: r["count"] for r in named.groupBy("l").count().collect()})
    if not names:
        return Languages([])
    spark, size = rows.sparkSession, len(names)
    named = named.filter(F.col("l").isin(names)).select("l", "t", F.lit(None).cast("string").alias("a"))
    every = named.unionByName(rows.select(F.lit(None).cast("string").alias("l"), F.col("p").alias("t"), "a"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], bool]]:
        """(labels, texts, whether these are pairs), some at a time."""
        for b in (whole.slice(i, 4000) for whole in batches for i in range(0, whole.num_rows, 4000)):
            got = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for plain in (False, True):
                some = [x for x in got if (x[0] is None) == plain]
                if some:
                    yield [x[0] for x in some], [t for x in some for t in ((spoken(x[1])[0], x[2] or "") if plain else (x[1],))], plain

    def counted(texts: DataFrame, model: Languages | None) -> list[Languages]:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bags = _Bags(size, *([shared.value.word] if model else []))
            for said, ts, plain in parts(batches):
                ids, at = bags.take(ts)
                bags.tally(ids, at, bags.likeliest(ids, at) if model else np.array([names.index(x) for x in said]), plain)
                if len(bags.known) > most:
                    yield bags.counts()
                    bags.clear()
            yield bags.counts()

        n = texts.mapInArrow(run, "word string, l int, n bigint, m bigint, h bigint").groupBy("word").agg(F.sum("h").alias("h"), *[F.sum(F.when(F.col("l") == k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k in range(size) for x in "nm"])
        n = keep(n.select("word", *[(F.col(f"n{k}") + F.when(F.col("h") >= 3, F.col(f"m{k}")).otherwise(0)).alias(f"n{k}") for k in range(size)]), "language-words")

        places = [f"n{k}" for k in range(size)]

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, size), np.int64)
            for b in batches:
                half = np.array([_half(w) for w in b.column(0).to_pylist()], np.int64)
                np.add.at(out, half, np.stack([c.to_numpy() for c in b.columns[1:]], axis=1))
            yield pa.record_batch([pa.array([0, 1], pa.int32()), *map(pa.array, out.T)], names=["half", *places])

        by_half = n.mapInArrow(total, "half int, " + ", ".join(f"{c} bigint" for c in places)).groupBy("half").agg(*[F.sum(c).alias(c) for c in places]).collect()
        totals = np.array([list(r)[1:] for r in sorted(by_half, key=lambda r: r["half"])], np.int64).reshape(-1, size)
        cols = [f"w{k}" for k in range(3 * size)]

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, w = _gram_sums(b.column(0).to_pylist(), np.stack([c.to_numpy() for c in b.columns[1:]], axis=1), totals)
                yield pa.record_batch([pa.array(g, pa.string()), *map(pa.array, w.reshape(len(g), 3 * size).T)], names=["gram", *cols])

        got = n.mapInArrow(grams, "gram string, " + ", ".join(f"{c} bigint" for c in cols)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
        return _models(names, got["gram"].to_pylist(), np.stack([got[c].to_numpy() for c in cols], axis=1).reshape(-1, 3, size))

    first = counted(named, None)[0]
    second = counted(named, first)[0]
    m, *halves = counted(every, second)
    shared = spark.sparkContext.broadcast((second, m, halves))

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, all_, two = shared.value
        bags = _Bags(size, by.word, all_.word, _other_half(two))
        for _, ts, _ in parts(batches):
            x = _fits(bags, ts)
            if len(bags.known) > most:
                bags.clear()
            both = np.concatenate([np.stack([x[:, 0], np.full(len(x), k), np.rint(x[:, 1 + k] * 1e4)], axis=1) for k in (0, 1)]).astype(np.int64)
            u, n = np.unique(both, axis=0, return_counts=True)
            yield pa.record_batch([*map(pa.array, u.T), pa.array(n)], names=["l", "k", "fit", "n"])

    got = every.mapInArrow(fits, "l bigint, k bigint, fit bigint, n bigint").groupBy("l", "k", "fit").agg(F.sum("n").alias("n")).toArrow()  # a row for each ten-thousandth of a fit
    l, k, fit, n = (got[c].to_numpy() for c in ("l", "k", "fit", "n"))
    m.usual = np.array([np.mean([_least(fit[(l == x) & (k == y)] / 1e4, n[(l == x) & (k == y)]) for y in (0, 1)]) if (l == x).any() else -1e9 for x in range(size)])
    return m


def train_languages(got: list[tuple[str, str]], plain: list[str]) -> Languages:
    """The models of (label, text) and of unlabelled texts. Labels of under half a percent of the texts are taken for slips; as others are wrong too, the
    texts are relabelled by the models they gave, twice. Unlabelled texts take the label the models give, and only their words that three texts
    or more hold count. What to expect of a text's fit: each half of the words by the model of all, and by one of the other half, as half of a text's words may be new."""
    names = _enough(Counter(x for x, _ in got))
    if not names:
        return Languages([])
    got = [(x, t) for x, t in got if x in names]

    def counted(model: Languages | None, *more: str) -> list[Languages]:
        bags = _Bags(len(names), *([model.word] if model else []))
        for some, is_plain in (([t for _, t in got], False), (list(more), True)):
            ids, at = bags.take(some)
            bags.tally(ids, at, bags.likeliest(ids, at) if model else np.array([names.index(x) for x, _ in got] if not is_plain else [], np.int64), is_plain)
        held = bags.held[:, : len(bags.known) * len(names)].reshape(3, -1, len(names))
        n = held[0] + np.where(held[2].sum(axis=1, keepdims=True) >= 3, held[1], 0)
        half = np.array([_half(w) for w in bags.known], np.int64)
        return _models(names, *_gram_sums(list(bags.known), n, np.stack([n[half == h].sum(axis=0) for h in (0, 1)])))

    second = counted(counted(None)[0])[0]
    m, *halves = counted(second, *plain)
    x = _fits(_Bags(len(names), second.word, m.word, _other_half(halves)), [*(t for _, t in got), *plain])
    m.usual = np.array([np.mean([_least(f := x[x[:, 0] == i, 1 + k], np.ones(len(f), np.int64)) for k in (0, 1)]) if (x[:, 0] == i).any() else -1e9 for i in range(len(names))])
    return m


# A refusal, as a grammar. Words have classes; a clause declines by one of the rules below; a text is a refusal if it holds a clause
# that declines and, besides, only openers, courtesies and at most one short plain sentence before.
#: classes of words and word beginnings (*) of refusals in several languages: fixed values
LEXICON = {
    "self": "i we ich wir yo nosotros je j nous eu nós я мы ik wij io noi jag",
    "own": "me us my our mir uns mein* unser* mi nos mon ma notre meu minha мне нам мой наш* mij ons mijn onze mio mia",
    "not": "not cannot never no nothing nor nicht kein* nichts nie ne pas aucun* rien nunca nada ningun* não nenhum* не нет ни нельзя niet geen non nessun* inte inget nie değil hayır",
    "aux": "do am are will would shall must have need want habe bin werde suis ai ben heb sono estoy estou har är",
    "can": "can could able may allowed permitted possible position comfortable willing free grado capace stande lage mesure condiciones staat kann können könnte darf dürfen möchte möglich puedo podemos podría posible permitido peux pouvons puis possible autorisé posso podemos possível permitido могу можем можно вправе буду kan kunnen mag mogen wil possiamo riesco possibile kan får möjligt mogę możemy wolno",
    "cannot": "unable incapable nequeo impossible inappropriate improper unwilling außerstande unmöglich imposible incapaz impossível impossibile не-могу onmogelijk yapamam edemem veremem cevaplayamam yardımcı-olamam",
    "refuse": "decline refuse refrain abstain reject skip pass declined refused ablehnen verweiger* declino rechaz* niego refus* recus* отказ* weiger* rifiut* avböj* odmaw* reddediyorum",
    "rule": "guideline* polic* rule* instruction* programming scope richtlinie* vorgabe* regeln política* normas directrices politique* règles consignes правила инструкции beleid richtlijnen regole linee",
    "bars": "prevent* forbid* prohibit* against bar* restrict* outside beyond limits verbiet* untersag* prohíb* impid* interdi* proíb* запрещ* verbied* viet* impedi* förbjud* zabrani*",
    "task": "help assist answer comment comments analy* provide describ* discuss* say summar* judg* assess* comply respond respons* explain* explanation* request question do share give offer speculat* evaluat* opinion* helfen antwort* beantwort* sagen analysier* auskunft kommentar* ayud* respond* contest* decir analiz* describ* aid* répond* dire analys* fourni* décri* ajud* respond* descrev* dizer помо* ответ* отвеч* сказать описы* анализ* комментир* help* antwoord* beantwoord* zeggen aiut* rispond* fornire descriv* dire hjälpa svara säga pomóc odpowied*",
    "given": "given provided offered made available shared supplied",
}
_CLASSES: dict[str, set[str]] = {}
_BEGINNINGS: list[tuple[str, str]] = []
for _class, _ws in LEXICON.items():
    for _w in _ws.split():
        if _w.endswith("*"):
            _BEGINNINGS.append((_w[:-1], _class))
        else:
            _CLASSES.setdefault(_w, set()).add(_class)
#: the same for scripts without blanks between words: fixed values
_JOINED = re.compile(r"\w{2,}(?:yamam|yemem|amam|emem|amayız|emeyiz)\b|(?:我|我们|本人)?[^。！？]{0,6}(?:无法|不能|不便|不会|拒绝|無法)[^。！？]{0,12}(?:帮|提供|回答|描述|分析|评论|协助|回應|説明|说)|(?:お答え|お手伝い|回答|提供)[^。！？]{0,8}(?:できません|いたしかねます|お断り)|(?:답변|도움|제공)[^.!?]{0,10}(?:수 없|어렵습니다|거절)")
_OPENER = re.compile(
    r"^\W*(?:(?:(?:i['’]m|i am|we['’]re|we are) )?(?:so |very |really |truly )?sorry|my apologies|apologies|unfortunately|regrettably|i apologi[sz]e|i(?:['’]m| am) afraid|thanks? (?:you )?for [^,.!;:]*|thank you[^,.!;:]*|i understand[^,.!;:]*|i appreciate[^,.!;:]*|as an? (?:ai|assistant|language model|ai language model|ai assistant|model)[^,.!;:]{0,25}?(?=[,.!;:]| i\b| this\b| we\b| my\b)|lo siento|lamentablemente|leider|(?:es )?tut mir leid|désolée?|je suis désolée?|malheureusement|entschuldigung|desculpe|infelizmente|к сожалению|извините|простите|helaas|het spijt (?:me|ons)|sorry|purtroppo|mi dispiace|ci dispiace|tyvärr|niestety|przepraszam|üzgünüm|maalesef|抱歉|对不起|很抱歉|申し訳ありません|죄송합니다)(?![^\W\d_])[\s,.!;:–—，。-]*(?:but |however,? |yet |and |aber |pero |mais |mas |но |maar |ma |men )?",
    re.I,
)
_CLOSER = re.compile(r"\b(?:please|let me know|is there (?:any|some)thing|would you like|feel free|perhaps|happy to help|another (?:question|request|list)|instead|anything else|bitte|por favor|veuillez|пожалуйста|alstublieft|per favore|per cortesia)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s*(?=\S)")
_CLAUSE = re.compile(r"[,;:–—]\s|\s(?:but|and|because|so|since|aber|denn|weil|pero|porque|mais|car|mas|но|maar|want|ma|perché)\s", re.I)


@lru_cache(200_000)
def _word_classes(w: str) -> set[str]:
    got = set(_CLASSES.get(w, ()))
    got.update(c for start, c in _BEGINNINGS if w.startswith(start))
    return got


@lru_cache(200_000)
def _may_decline(w: str) -> bool:
    return w in ("off", "t") or not _word_classes(w).isdisjoint(("not", "cannot", "refuse", "bars"))


def _says_no(text: str) -> bool:
    """Some word of the text is one that declining takes."""
    return any(map(_may_decline, words(text))) or not text.isascii() and bool(_JOINED.search(text))


def _declines(clause: str) -> bool:
    """A clause that declines, by one of these rules, whose parts lie a few words apart: the speaker, as subject, with a negation and an ability or an
    auxiliary, the task or a short clause following; the speaker who refuses, or would rather not; a negated ability in a verb form that holds the
    first person; what is impossible or improper for the speaker; rules that bar or don't allow; an answer that isn't given."""
    if not _says_no(clause):
        return False
    if _JOINED.search(clause):
        return True
    low = re.sub(r"\b[IVX]{2,}\b", "", clause).lower()  # numerals of titles
    low = re.sub(r"n['’]t\b", " not", re.sub(r"\bwon['’]t\b", "will not", re.sub(r"\bcan(?:['’]t|not)\b", "can not", low)))
    ws = words(re.sub(r"['’](?:m|re)\b", " am", re.sub(r"['’](?:d|ll|ve)\b", " will", low)))
    at: dict[str, list[int]] = {}
    for i, w in enumerate(ws):
        for c in _word_classes(w):
            at.setdefault(c, []).append(i)
    of = lambda c: at.get(c, ())
    asked = lambda i, most=9: len(ws) <= most or any(-4 <= t - i <= 9 for t in of("task"))
    for i in of("self"):
        for k in of("not"):
            if -3 <= k - i <= 5 and (any(-4 <= c - k <= 3 and -3 <= c - i <= 6 for c in of("can")) and asked(k, 14) or any(-2 <= c - k <= 3 and -3 <= c - i <= 6 for c in of("aux")) and asked(k)):
                return True
        if any(0 < k - i <= 4 for k in of("cannot")) and asked(i) or any(0 < k - i <= 6 for k in of("refuse")):
            return True
    for k in of("not"):
        if any(abs(c - k) <= 3 and ws[c] in _FIRST for c in of("can")) and asked(k):
            return True
    if of("own") and any(0 < o - k <= 3 for o in of("own") for k in (*of("cannot"), *(c for c in of("can") if any(0 < c - n <= 2 for n in of("not"))))) and asked(of("own")[0]):
        return True
    if any(abs(r - b) <= 6 for r in of("rule") for b in of("bars")) or of("own") and any(0 < n - r <= 4 for r in of("rule") for n in of("not")):
        return True
    if any(0 < s - b <= 5 for b in of("bars") if ws[b] in ("outside", "beyond") for s in (*of("self"), *of("own"))) or any(a == "off" and b == "limits" for a, b in zip(ws, ws[1:], strict=False)):
        return True
    if any(0 < g - k <= 8 and any(k < t < g for t in of("task")) for k in of("not") for g in of("given")):
        return True
    return len(ws) <= 2 and bool(of("not")) and (bool(of("task")) or ws == ["no"])


#: verbs and adverbs whose form holds the first person: fixed values
_FIRST = {"puedo", "podemos", "posso", "possiamo", "riesco", "grado", "могу", "можем", "mogę", "możemy"}


def is_refusal(text: str) -> bool:
    """The text is openers, a sentence that declines and courtesies, with at most one short plain sentence before; an apology within an answer is none."""
    core, plain = False, 0
    for s in _SENTENCE.split(text.strip()):
        rest = s
        while (m := _OPENER.match(rest)) and m.end():
            rest = rest[m.end() :]
        if not rest.strip(" .!,;:。，"):
            continue
        n = len(words(rest))
        if n < 40 and _says_no(s) and (any(_declines(c) for c in _CLAUSE.split(s)) or _declines(s)):
            core = True
        elif core:
            if not _CLOSER.search(rest):
                return False
        else:
            plain += 1
            if plain > 1 or n > 25:
                return False
    return core


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of words first, each word of either side in one tile at most: [(at a, at b, length)]."""
    where: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(tuple(b[j : j + least]), []).append(j)
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best: list[tuple[int, int]] = []
        size = least
        i = 0
        while i <= len(a) - size:
            for j in where.get(tuple(a[i : i + least]), ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > size:
                    best, size = [], n
                if n == size:
                    best.append((i, j))
            i += 1
        if not best:
            return out
        placed = False
        for i, j in best:
            if all(free_a[i : i + size]) and all(free_b[j : j + size]):
                free_a[i : i + size] = free_b[j : j + size] = [False] * size
                out.append((i, j, size))
                placed = True
        if not placed:
            return out


def copied_share(answer: list[str], prompt: list[str], least: int = 3) -> tuple[float, float]:
    """(share of the answer, share of the prompt) in common tiles."""
    grams = {tuple(prompt[j : j + least]) for j in range(len(prompt) - least + 1)}
    cover = [False] * len(answer)
    for i in range(len(answer) - least + 1):
        if tuple(answer[i : i + least]) in grams:
            cover[i : i + least] = [True] * least
    if 2 * sum(cover) < len(answer) or not answer:  # tiles cover no more than all common runs do
        return (sum(cover) / len(answer) if answer else 0.0), 0.0
    n = sum(t[2] for t in tiles(answer, prompt, least))
    return n / len(answer), n / max(1, len(prompt))


_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
_END = re.compile(r"[.!?。！？][\"'”’»)\]}*_`]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\"'”’»)\]}]*$")


def open_constructs(text: str) -> list[str]:
    """What a pushdown parse leaves open at the end: fences, brackets, quotation marks, markup tags, emphasis, a bare list marker."""
    stack: list[str] = []
    i, fence = 0, False
    while i < len(text):
        if text.startswith("```", i):
            if fence:
                while stack and stack.pop() != "```":
                    pass
            else:
                stack.append("```")
            fence = not fence
            i += 3
            continue
        c = text[i]
        if stack and stack[-1] not in ("```", '"') and c == stack[-1]:
            stack.pop()
        elif c == '"' and not (i and text[i - 1].isdigit()):
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append('"')
        elif c in _OPEN and not (c == "“" and stack and stack[-1] == "“"):
            stack.append(_OPEN[c])
        elif c in ")]}”»" and c in stack:
            while stack.pop() != c:
                pass
        i += 1
    for m in re.finditer(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>", text):
        if m[1] and f"<{m[2]}>" in stack:
            stack.remove(f"<{m[2]}>")
        elif not m[1] and not m[3] and m[2].lower() not in ("br", "hr", "img", "input", "p", "li"):
            stack.append(f"<{m[2]}>")
    if re.search(r"<[a-zA-Z/][^<>]*$", text):
        stack.append("<")
    if text.count("**") % 2:
        stack.append("**")
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$", text):
        stack.append("list")
    return stack


#: capitalised words that are no names: fixed values
CALENDAR = {"i", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}


def _classes(text: str) -> Iterator[tuple[str, int]]:
    """(class, end) of each word: its lower case, or <name> for a capital within a sentence, <num> for digits."""
    start = True
    for m in WORD.finditer(text):
        w = m[0]
        yield ("<num>" if w[0].isdigit() else "<name>" if w[0].isupper() and not start and w.lower() not in CALENDAR else w.lower()), m.end()
        tail = text[m.end() : m.end() + 2]
        start = bool(tail) and tail[0] in ".!?"


#: how often a run of four, three, two and one word classes must have been seen to be believed
LEAST = (3, 4, 6, 8)


def _runs(cs: tuple[str, ...] | list[str]) -> list[int]:
    """64-bit hashes of the runs of four, three, two and one word classes that end the last."""
    last = ["<s>", "<s>", "<s>", *cs[-4:]][-4:]
    return [xxhash.xxh3_64_intdigest(" ".join(last[k:])) - (1 << 63) for k in range(4)]


def sentence_ends(df: DataFrame, text: str, most: int = 200_000) -> DataFrame:
    """(run, seen, ended) over all texts: how often each run of one to four word classes occurs and how often it ends a
    sentence. A text's last word is counted only if a full stop follows it. A task hands on its counts after every `most` runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[int]] = {}

        def add() -> pa.RecordBatch:
            runs: dict[int, list[int]] = {}
            for key, (n, e) in known.items():
                for x in _runs(key):
                    k = runs.setdefault(x, [0, 0])
                    k[0] += n
                    k[1] += e
            known.clear()
            cols = [list(runs), [n for n, _ in runs.values()], [e for _, e in runs.values()]]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["run", "seen", "ended"])

        for b in batches:
            for t in b.column(0).to_pylist():
                got = list(_classes(t))
                cs = [c for c, _ in got]
                for i, (_, end) in enumerate(got):
                    tail = t[end : end + 1]
                    if i == len(got) - 1 and tail not in (".", "!", "?"):
                        continue
                    k = known.setdefault(tuple(cs[max(0, i - 3) : i + 1]), [0, 0])
                    k[0] += 1
                    k[1] += tail in (".", "!", "?")
                if len(known) > most:
                    yield add()
        yield add()

    rows = df.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(count, "run bigint, seen bigint, ended bigint")
    return rows.groupBy("run").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def breaks_off(text: str) -> bool | list[int]:
    """The text stops within a sentence or word. Where a full stop may only be missing, the runs that tell by what its last words end in the corpus."""
    t = text.rstrip()
    if _ELLIPSIS.search(t):
        return True
    left = open_constructs(t)
    if _END.search(t) and not left:
        return False
    if any(x != "**" and x != '"' or not _END.search(t) for x in left) and left:
        return True
    got = list(_classes(t))
    if not got or t[got[-1][1] :].strip("\"'”’»)]}*_` "):  # a comma, colon, dash
        return True
    return _runs([c for c, _ in got])


def within_sentence(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """ends (runs) once each, with `within`: the longest run seen often enough ends a sentence in under half of its places; true if none was."""
    each = ends.select("runs").distinct().select("runs", F.posexplode("runs").alias("k", "run")).join(counts, "run", "left")
    often = F.col("seen") >= F.array(*map(F.lit, LEAST))[F.col("k")]
    told = F.min(F.when(often, F.struct("k", (F.col("ended") < 0.5 * F.col("seen")).alias("within"))))
    return each.groupBy("runs").agg(told.alias("m")).select("runs", F.coalesce("m.within", F.lit(True)).alias("within"))


class Judge:
    def __init__(self, languages: Languages, copy_share: float = 0.6):
        self.languages, self.copy_share = languages, copy_share

    def defect(self, prompt: str | None, answer: str | None) -> str | list[int] | None:
        """The defect; runs, where they tell whether the answer is truncated."""
        a = (answer or "").strip().strip("​﻿")
        plain = " ".join(words(a))
        if plain in PLACEHOLDERS:
            return "empty"
        if is_refusal(a):
            return "refusal"
        p = prompt or ""
        pw, aw = words(p), words(a)
        share, of_prompt = copied_share(aw, pw)
        if share >= self.copy_share and (of_prompt >= 0.5 or share >= 0.85 and len(aw) >= 12 or share >= 0.95 and len(aw) >= 6):
            return "copied"
        said, listed = spoken(p)
        body = a
        for x in listed:  # titles don't count
            title = re.sub(r"^\s*(?:\d+[.)]|[-*•])\s*", "", x).split(" [")[0].strip()
            if len(title) > 3:
                body = body.replace(title, " ")
        if self.languages.other(said, body):
            return "language"
        off = breaks_off(a)
        return "truncated" if off is True else off or None


_OUT = pa.schema([("id", pa.int64()), ("defect", pa.string()), ("runs", pa.list_(pa.int64()))])


def broken_pairs(pairs: DataFrame, key: str, prompt: str, answer: str, labelled: DataFrame | None = None, copy_share: float = 0.6) -> DataFrame:
    """(key bigint, defect) of each defective pair: empty, refusal, copied, language or truncated, tested in this order.

    A null or blank answer is empty; a null prompt leaves the tests that need none. Null keys are left out. A key sent
    again counts once, with the first defect by name over its rows. An empty table gives no rows; other columns are not read. Whole texts
    are parsed. labelled (text, lang): texts that train the language models with the pairs, all of either; without, only scripts are told apart.
    The corpus counts behind `truncated` are exact, by 64-bit hashes, and joined to the
    answers that end without a full stop.
    """
    rows = keep(pairs.select(F.col(key).cast("long").alias("id"), F.col(prompt).alias("p"), F.col(answer).alias("a")).filter("id is not null"), "pairs")

    models = learn_languages(labelled, rows) if labelled is not None else Languages([])
    shared = rows.sparkSession.sparkContext.broadcast(models)  # n-grams of up to four characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(shared.value, copy_share)
        for b in batches:
            rows = [(k, d) for k, p, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if (d := j.defect(p, a))]
            cols = [[k for k, _ in rows], [d if isinstance(d, str) else None for _, d in rows], [d if isinstance(d, list) else None for _, d in rows]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    judged = keep(rows.mapInArrow(run, "id bigint, defect string, runs array<bigint>"), "judged")
    ends = judged.filter("defect is null").select("id", "runs")
    cut = ends.join(within_sentence(ends, sentence_ends(rows, "a")).filter("within"), "runs").select("id", F.lit("truncated").alias("defect"))
    return judged.filter("defect is not null").select("id", "defect").unionByName(cut).groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", key)
