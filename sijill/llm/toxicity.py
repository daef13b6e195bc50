"""Problem 10: abusive, hateful and sexual language.

A factorization machine over hashed terms scores every sentence of every document; its
pairwise interactions learn what additive weights miss, such as an insult beside an
address or a group beside a degradation, and leave alone the same words in a rule or a
report. Reviewed texts are the training set; inside longer ones the model itself finds
the sentence that carries the label.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import stored, table, texts

CATEGORIES = ("abusive", "hateful", "sexual")
#: Hash space, factors and training steps; at most so many reviewed texts are read to the driver.
BITS, FACTORS, EPOCHS, REFINE, BATCH, RATE, DECAY, SCALE, MAX_REVIEWED = 16, 8, 25, 10, 8, 0.08, 2e-4, 2.0, 50_000
#: Words scored at once, and different words a worker remembers.
RUN, KNOWN = 50_000, 500_000
#: Words the machine knows nothing of leave a sentence near the bias, at some hundredths; evidence lifts it far beyond.
THRESHOLD = 0.06

_FOLD = str.maketrans("أإآٱىةیکہے", "اااايهيكهي", "ـ")
# Letters written as digits or signs inside Latin words.
_LEET = str.maketrans("013457@$", "oieastas")
# General classes of words (stems end with -), as prior knowledge beside the reviewed texts.
CLASSES = {
    "you": "you your yours yourself youre ur انت انتم انتي اياك عليك لك بك منك فيك وجهك راسك عينك نفسك امك ابوك عائلتك اهلك اولادك بيتك اسنانك مثلك ولدك تسكن تو تۆ ئێوه سەرت",
    "call": "يا ايها ايتها اسكت اخرس اغرب shut listen damn ئهي ئەی",
    "insult": "stupid idiot- moron- bastard- pig pigs cow rat maggot- trash coward- pathetic filthy worthless scum loser- fool dumb crooked backside ass asshole bitch dirt dog donkey smug disgusting "
    "غبي- اغبي اغبياء حمار حمير كلب كلاب خنزير خنازير قذر قذره حقير- تافه- سافل- نذل انذال وغد احمق حمقي لعين لعنه قبيح عديم جبان جبناء وسخ قرف القرف بصقه حثاله صعلوك گهوج گەوج سەگ کەر بێشەرف بیشهرف",
    "threat": "kill- bullet bat bone bones break smash slap slapped rot die dead beat punch regret hole waiting stab shoot strangle live night happens "
    "اقتل- ساقتل اكسر ساكسر اهشم ساهشم ستندم تندم تموت صفع الصفع صفعه ساحرق رصاصه سافعل افعله انتظرك سانتظرك ستري تلومن اذبح ساذبح دهكوژم دەکوژم",
    "group": "immigrant- refugee- minorit- foreigner- tribe race مهاجر- لاجئ- اقليات اقليه اجانب طائفه قوميه",
    "dehuman": "vermin germs lice rats breed breeding thief thieves filth animals parasites plague disease stink stinks stench blood lazy laziness dirty humans human born "
    "جراثيم جرذان جرذ كالجرذان يتكاثرون حشرات انجاس نجس لص لصا لصوص بشرا قذاره القذاره الكسل كسل دمهم دم حيوانات طاعون وباء",
    "expel": "expel- burn drive driven disappear deport- wipe cleanse clean mark doors force decent houses place district send trucks daughter marries احرقوا اطردوا طردهم يجب يختفي ابيدوا علامه ابواب بالقوه الشرفاء مكان تنظف توظفوا تمنحوا",
    "nude": "naked nude- strip- undress- unclothed عاريه عاريات عاري عاريا يتعريان يتعري تتعري تعري عرايا ثوبها خلعت اخلعي ڕووت",
    "desire": "bed moan- horny wet slut- hot hard lick- tongue sweating kiss- sex sexy porn- orgasm lust- erotic aroused يلعق سرير سريري شهوان- ساخن ساخنه ساخنات مثيره مشتعل شوق الشوق قبلات اباحي- تلاحمت جنس سێکس",
    "body": "body bodies breast- thigh- lips girls dress robe skin couple جسد جسدها جسدك جسدي اجسادهما فتيات صدرها عباءه العباءه تلبسين لحم زوجين",
    "watch": "watch video- camera pictures photos uncensored click tonight everything شاهد فيديو- كاميرا الكاميرا صورك اضغط رقابه الليله الليل خدمه اسئله",
    "office": "report article section fine penalty workshop clinic health court hearing charged defendant pursuant forbidden control witness statement motion committee licence safety surfaces stores colony medical "
    "الماده ماده غرامه بالغرامه قانون ورشه الورشه عياده العياده محكمه المحكمه متهم المتهم عقوبه جلسه الجلسه مستوصف المستوصف مخازن المخازن مديريه المديريه شعبه الشعبه اتفاقيه اسلاك الاسلاك جمعيه مدرسه خزان عهده حراسه الحراسه نحاس",
}
#: Pairs of classes and what they make of a sentence; the machine starts from these.
PRIORS = [
    ("you insult", "abusive"), ("call insult", "abusive"), ("you threat", "abusive"), ("you call insult", "abusive"), ("you insult threat", "abusive"), ("insult threat", "abusive"),
    ("group dehuman", "hateful"), ("group expel", "hateful"), ("group expel dehuman", "hateful"), ("group threat", "hateful"), ("group insult", "hateful"),
    ("nude desire", "sexual"), ("nude body", "sexual"), ("nude watch", "sexual"), ("nude you", "sexual"), ("desire body", "sexual"), ("desire watch", "sexual"), ("desire you", "sexual"),
    ("nude", "none"), ("desire", "none"), ("body", "none"), ("watch", "none"), ("body watch", "none"), ("body you", "none"), ("watch you", "none"),
    ("group", "none"), ("insult", "none"), ("threat", "none"), ("dehuman", "none"), ("expel", "none"), ("you", "none"), ("call", "none"), ("office", "none"),
    ("office insult", "none"), ("office nude", "none"), ("office desire", "none"), ("office body", "none"), ("office nude desire", "none"), ("office group", "none"), ("office dehuman", "none"),
    ("office threat", "none"), ("office group expel", "none"), ("office insult dehuman", "none"),
    ("office you", "none"), ("office nude desire", "none"),
]
#: The class of what takes turns in one place of the reviewed texts of a category.
SLOT_CLASS = {"abusive": "insult", "hateful": "group", "sexual": "desire"}
#: A sentence longer than this is also read in overlapping windows of this many words.
WINDOW = 16
_SENTENCE = re.compile(r"[.!?؟؛;:\n\r…«»]+")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]+[^\W\d_](?!\S)){2,}(?!\S)")
_RUN = re.compile(r"(.)\1{2,}")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$]+[^\W_]*)*|[*#@$]+[^\W_]+")
_MASK = re.compile(r"[*#@$]")
_ARABIC_HEAD = re.compile(r"^(?:وال|بال|فال|كال|لل|ال|و|ف|ب|ل)(?=...)")


#: Folding and the dropping of marks and invisible characters in one table.
_PLAIN = {cp: None for cp in range(0x80, 0x10000) if unicodedata.category(chr(cp)) in ("Mn", "Cf", "Me")} | _FOLD


def plain(text: str) -> str:
    """Shapes, marks, stretching and invisible characters folded; lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_PLAIN)
    return text.casefold()


def _joined(m: re.Match) -> str:
    return re.sub(r"[\W_]+", "", m[0])


_EXACT: dict[str, set[str]] = {}
_STEMS: list[tuple[str, str]] = []
for _name, _list in CLASSES.items():
    for _w in _list.split():
        if _w.endswith("-"):
            _STEMS.append((plain(_w[:-1]), _name))
        else:
            _EXACT.setdefault(plain(_w), set()).add(_name)


def _classes_of(forms: set[str]) -> set[str]:
    out: set[str] = set()
    for form in forms:
        out |= _EXACT.get(form, set())
        out |= {name for stem, name in _STEMS if form.startswith(stem)}
    return out


class Terms:
    """Words to hashed terms. `lexicon` resolves masked letters ("st*pid") by words of the reviewed texts."""

    def __init__(self, lexicon: set[str] = frozenset(), lists: bool = True):
        self.lists = lists
        self.by_length: dict[int, list[str]] = {}
        self.slots: dict[str, str] = {}
        for word in lexicon:
            self.by_length.setdefault(len(word), []).append(word)

    def _unmask(self, word: str) -> str:
        pattern = re.compile("".join("." if _MASK.match(c) else re.escape(c) for c in word))
        hits = [w for w in self.by_length.get(len(word), ()) if pattern.fullmatch(w)]
        if not hits:
            # a prefix may stand before the masked word
            for head in ("ال", "وال", "بال", "لل", "و"):
                if word.startswith(head):
                    tail = re.compile("".join("." if _MASK.match(c) else re.escape(c) for c in word[len(head) :]))
                    hits += [w for w in self.by_length.get(len(word) - len(head), ()) if tail.fullmatch(w)]
        return min(hits, key=lambda w: (not _classes_of({w, _ARABIC_HEAD.sub("", w)}), w)) if hits else word

    def word(self, raw: str) -> str:
        word = _RUN.sub(r"\1", raw)
        if word.isascii() and not word.isdigit() and re.search(r"[a-z]", word) and re.search(r"[0134 57@$]", word):
            leet = word.translate(_LEET)
            word = leet if leet.isalpha() else word
        if _MASK.search(word):
            word = self._unmask(word)
        return word

    def of_word(self, raw: str) -> list[int]:
        """Hashes of the word, of its stem without Arabic prefixes and common endings, and of its classes; numbers are one term."""
        word = self.word(raw)
        names = {"#" if word.isdigit() else word}
        if not word.isdigit():
            stem = stem_of(word)
            classes = (_classes_of({word, _ARABIC_HEAD.sub("", word)}) if self.lists else set()) | {self.slots[s] for s in (stem,) if s in self.slots}
            names |= {"~" + stem, *("@" + c for c in classes)}
        return [_hash(n) for n in sorted(names)]

    def learn_slots(self, samples: list[tuple[str, str]]) -> None:
        """Words that take turns in one place of otherwise equal reviewed text belong together.

        What varies so in hateful texts is the group attacked, in abusive ones the insult,
        in sexual ones the desire. A place counts from three different words on, unless
        clean texts have it too.
        """
        places: dict[tuple[str, str], dict[str, set[str]]] = {}
        for text, label in samples:
            for part in _SENTENCE.split(_SPACED.sub(_joined, plain(text).replace("_", " "))):
                stems = [stem_of(self.word(t)) for t in _TOKEN.findall(part)]
                for before, here, after in zip(stems, stems[1:], stems[2:]):
                    places.setdefault((before, after), {}).setdefault(label, set()).add(here)
        for _, by_label in sorted(places.items()):
            for label, fillers in by_label.items():
                if label in SLOT_CLASS and len(fillers) >= 3 and len(by_label) == 1:
                    self.slots |= {f: SLOT_CLASS[label] for f in fillers if len(f) > 2 and f.isalpha()}


def stem_of(word: str) -> str:
    """A word without Arabic prefixes and common endings."""
    head = _ARABIC_HEAD.sub("", word)
    return re.sub(r"(?:يون|يين|ون|ين|ات|يه|ه|ا)$", "", head) if not head.isascii() else re.sub(r"(?:ing|ies|ed|is|i|s|y)$", "", head)


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


class Layout:
    """Texts as one run of tokens, and the spans of it that are scored: sentences, and windows of long ones."""

    def __init__(self):
        self.tokens: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.owner: list[int] = []

    def _span(self, owner: int, a: int, b: int, whole: bool) -> None:
        for k in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2):
            self.start.append(k)
            self.end.append(min(b, k + WINDOW))
            self.owner.append(owner)
        if whole and b - a > WINDOW:
            self.start.append(a)
            self.end.append(b)
            self.owner.append(owner)

    def add(self, owner: int, text: str) -> None:
        """A text's sentences by lines and marks, and windows across line ends; each word is read once."""
        text = _SPACED.sub(_joined, plain(text).replace("_", " "))
        run, parts, last = len(self.tokens), 0, 0
        for m in chain(_SENTENCE.finditer(text), (None,)):
            a = len(self.tokens)
            self.tokens += _TOKEN.findall(text[last : m.start()] if m else text[last:])
            b = len(self.tokens)
            if b > a:
                self._span(owner, a, b, True)
                parts += 1
            if m:
                last = m.end()
            if not m or not m[0].isspace():
                if parts > 1:  # what only line ends divide
                    self._span(owner, run, b, False)
                run, parts = b, 0


class FactorizationMachine:
    """One machine for each category over the same terms.

    score(x) = b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the terms of a span.
    Training runs over small batches with AdaGrad steps.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = -3.0  # language is clean until shown otherwise
        self.w = np.zeros(1 << BITS, np.float32)
        self.v = rng.normal(0, 0.05, (1 << BITS, FACTORS)).astype(np.float32)
        self.seen = np.zeros(1 << BITS, bool)

    def _sums(self, at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[at]
        total = np.add.reduceat(v, cut)
        z = self.b + np.add.reduceat(self.w[at], cut) / SCALE + 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), cut)) / SCALE**2
        return z, total

    def scores(self, spans: list[list[int]]) -> np.ndarray:
        return self._sums(*laid_out(spans))[0] if spans else np.zeros(0, np.float32)

    def fit(self, spans: list[list[int]], labels: np.ndarray, epochs: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        # each fit steps afresh, so what refines the machine can still move it
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(spans))
            for k in range(0, len(order), BATCH):
                chosen = order[k : k + BATCH]
                at, cut = laid_out([spans[i] for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), np.diff(np.append(cut, len(at))))
                z, total = self._sums(at, cut)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
                terms, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, g[owner], len(terms)) / SCALE + DECAY * self.w[terms]
                dv = np.zeros((len(terms), FACTORS))
                np.add.at(dv, back, g[owner, None] * (total[owner] - self.v[at]) / SCALE**2)
                dv += DECAY * self.v[terms]
                gb += float(g.sum()) ** 2
                self.b -= RATE * float(g.sum()) / np.sqrt(gb)
                gw[terms] += dw * dw
                gv[terms] += dv * dv
                self.w[terms] -= RATE * dw / np.sqrt(gw[terms])
                self.v[terms] -= RATE * dv / np.sqrt(gv[terms])
                self.seen[terms] = True

    def forget(self) -> None:
        """Terms that no training span held add nothing, rather than their random start."""
        self.v[~self.seen] = 0


def laid_out(spans: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    return np.fromiter(chain.from_iterable(spans), np.int64, int(sizes.sum())), np.concatenate([[0], sizes[:-1].cumsum()])


class Classifier:
    """One machine per category; a document's score is that of its worst span.

    A span's score needs only sums over its terms, so each different word is turned once
    into a row (weights, squares and factors of all machines, and which classes it has),
    and every span of a batch comes from running totals of these rows. A class counts once
    in a span however many of its words stand there; a repeated word counts each time.
    """

    def __init__(self, samples: list[tuple[str, str]], lists: bool = True):
        positives = [plain(t) for t, label in samples if label in CATEGORIES]
        words = {w for t in positives for w in _TOKEN.findall(_SPACED.sub(_joined, t)) if not _MASK.search(w)}
        self.terms = Terms(words, lists)
        self.terms.learn_slots(samples)
        texts = [([sorted(_hash("@" + c) for c in pair.split())], label) for pair, label in PRIORS for _ in range(3)] if lists else []
        texts += [(self._spans(text), label) for text, label in samples]
        self.machines = [self._learn(texts, category) for category in CATEGORIES]
        self._tabulate()

    def _spans(self, text: str) -> list[list[int]]:
        layout = Layout()
        layout.add(0, text)
        terms = [self.terms.of_word(t) for t in layout.tokens]
        seen = dict.fromkeys((a, b) for a, b in zip(layout.start, layout.end))
        return [sorted(set(chain.from_iterable(terms[a:b]))) for a, b in seen]

    @staticmethod
    def _learn(texts: list[tuple[list[list[int]], str]], category: str) -> FactorizationMachine:
        """Samples of one sentence teach first; then the sentence of a longer one that scores highest carries its label."""
        negative = [s for spans, label in texts if label not in CATEGORIES or len(spans) == 1 and label != category for s in spans]
        positive = [s for spans, label in texts if label == category and len(spans) == 1 for s in spans]
        machine = FactorizationMachine()

        def fit(pos, neg, epochs):
            if pos and neg:
                machine.fit(pos + neg, np.array([1.0] * len(pos) + [0.0] * len(neg)), epochs)

        fit(positive, negative, EPOCHS)
        for _ in range(2):
            chosen, rest = [], []
            for spans, label in texts:
                if label in CATEGORIES and len(spans) > 1:
                    best = int(machine.scores(spans).argmax()) if label == category else -1
                    for k, s in enumerate(spans):
                        (chosen if k == best else rest).append(s)
            fit(positive + chosen, negative + rest, REFINE)
        machine.forget()
        return machine

    def _tabulate(self) -> None:
        """Weights, factors and squares of all machines side by side: one gather scores a term for every category."""
        w = np.stack([m.w for m in self.machines], 1)
        v = np.concatenate([m.v for m in self.machines], 1)
        square = np.stack([(m.v * m.v).sum(1) for m in self.machines], 1)
        self.table = np.concatenate([w, square, v], 1).astype(np.float32)
        self.bias = np.array([m.b for m in self.machines])
        self.class_at = {_hash("@" + c): k for k, c in enumerate(CLASSES)}
        self.class_rows = self.table[list(self.class_at)].astype(np.float64)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, self.table.shape[1] + len(CLASSES)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machines": None, "known": {}, "rows": self.rows[:1024]}

    def _row(self, token: str) -> int:
        at = self.known[token] = len(self.known)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        terms = self.terms.of_word(token)
        width = self.table.shape[1]
        self.rows[at, :width] = self.table[[t for t in terms if t not in self.class_at]].sum(0, dtype=np.float64)
        self.rows[at, width:] = 0
        self.rows[at, [width + self.class_at[t] for t in terms if t in self.class_at]] = 1
        return at

    def _score(self, layout: Layout, out: np.ndarray) -> None:
        n, known, width = len(CATEGORIES), self.known, self.table.shape[1]
        ids = np.fromiter((known[t] if t in known else self._row(t) for t in layout.tokens), np.int64, len(layout.tokens))
        totals = np.zeros((len(ids) + 1, self.rows.shape[1]))
        np.cumsum(self.rows[ids], axis=0, out=totals[1:])
        spans = totals[layout.end] - totals[layout.start]
        spans = spans[:, :width] + (spans[:, width:] > 0.5) @ self.class_rows
        factors = spans[:, 2 * n :].reshape(len(spans), n, FACTORS)
        z = self.bias + spans[:, :n] / SCALE + 0.5 * ((factors * factors).sum(2) - spans[:, n : 2 * n]) / SCALE**2
        np.maximum.at(out, np.array(layout.owner), 1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """[text, category] probabilities; 0 for null texts and texts without words."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        layout = Layout()
        for i, text in enumerate(texts):
            if text:
                layout.add(i, text)
            if layout.start and (len(layout.tokens) >= RUN or i + 1 == len(texts)):
                self._score(layout, out)
                layout = Layout()
                if len(self.known) > KNOWN:
                    self.known.clear()
        if layout.start:
            self._score(layout, out)
        return out


def fit_classifier(samples: DataFrame, text: str, label: str) -> Classifier:
    """The machines for the given reviewed rows, trained once and kept in the shared folder.

    Reviewed rows are labelled by hand, few by nature; at most MAX_REVIEWED are read, in
    the order of their hash, so a larger set is sampled evenly. The stored model is named by
    a digest of the rows and this module, and is used by every later query on the same rows.
    """
    rows = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label)
    read = [(r[0], r[1]) for r in rows.orderBy(F.xxhash64(text, label), text, label).limit(MAX_REVIEWED).collect()]
    digest = hashlib.md5(repr((read, inspect.getsource(inspect.getmodule(Classifier)))).encode()).hexdigest()
    return stored(samples.sparkSession, f"classifier-{digest}", lambda: Classifier(read))


def score_documents(documents: DataFrame, key: str, field: str, model: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, abusive, hateful, sexual): the probability of the worst sentence for every document.

    Null and empty texts score 0; repeated rows are scored each. Documents are
    independent: no shuffle. The model's size is fixed by its hash space.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).cast("long").alias(key), F.col(field).alias("_text"), *keep)
    schema = ", ".join([f"`{key}` long", *[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} double" for c in CATEGORIES]])

    def run(batches):
        model = shared.value
        for batch in batches:
            p = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], *[pa.array(p[:, k]) for k in range(len(CATEGORIES))]], [key, *keep, *CATEGORIES])

    return rows.mapInArrow(run, schema)


def _scored(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    model = fit_classifier(table(spark, folder, "review_samples"), "text", "label")
    return score_documents(texts(spark, folder, "documents", "doc_id", "text", *keep), "doc_id", "text", model, keep)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES]))
    return _scored(spark, folder).select("doc_id", F.explode(hits).alias("category"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", *[F.round(c, 6).alias(c) for c in CATEGORIES])


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and rates per source."""
    scored = _scored(spark, folder, ("source",))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg((F.col(c) >= THRESHOLD).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
