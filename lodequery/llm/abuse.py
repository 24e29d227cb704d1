"""Problem 10: abusive, hateful or sexually explicit language.

Texts are folded first: accents and look-alike letters of another alphabet, digits that
stand for letters, spelt-out and stretched words, and letters hidden behind asterisks.
A weighted lexicon of words and short phrases is then matched in one Aho-Corasick pass.
Weights add up within a stretch of a sentence and are normalised by its length. Words that
can be said of things count in full only where someone is addressed or spoken about.
Exception phrases ("great tits", "breast cancer") cover their own words, and words that
announce a mention ("words like", "the term") discount only those next to them; no
exception reaches a whole sentence. A document is abusive if some stretch reaches the
threshold. Weights start from those written here and are fitted to labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.functions.urls import canonical_host

THRESHOLD = 2.0
#: Words that weights add up over, and words of a stretch beyond which its sum is divided by its length.
STRETCH_WORDS, FREE_WORDS = 30, 14
#: Share of its weight that a word about things has where nobody is meant; share left by a mention, and words it reaches.
NOBODY, MENTIONED, MENTION_WORDS = 0.5, 0.25, 8
#: Words before or after a word of scorn within which somebody must be meant.
MEANT_WORDS = 8
#: Labelled documents that weights are fitted to, at most; those of least hash of the id.
SAMPLE_LABELS = 4000
#: How steep the probability is around the threshold, and how strongly weights are held at their start.
STEEPNESS, HOLD, FIT_STEPS = 3.0, 8.0, 300
#: Share of labels taken to be wrong.
ERRORS = 0.1
SCORE_SCHEMA = "doc_id bigint, score double, density double, terms array<string>"

# The lexicon by kind, with the weight each entry starts from. A final * matches any ending.
LEXICON = {
    "attack": (2.0, (
        "fuck you|fuck yourself|fuck off|motherfuck*|cunt*|faggot*|nigger*|kike|kikes|wetback*|raghead*|towelhead*|kill yourself|hope you die|hope they die|rape you|"
        "son of a bitch|sons of bitches|piece of shit|suck my dick|suck my cock|gas the jews|"
        "hurensohn*|fick dich|fickt euch|verpiss dich|verpisst euch|halt die fresse|halt die schnauze|halt s maul|halts maul|leck mich am arsch|wichser*|fotze*|missgeburt*|kanake*|"
        "fils de pute|va te faire foutre|va te faire enculer|allez vous faire foutre|nique ta mère|nique ta race|ta gueule|enculé*|bougnoule*|sale pute|sales putes|sale arabe*|sale juif*|"
        "hijo de puta|hija de puta|hijos de puta|vete a la mierda|que te jodan|vete a tomar por culo|ojalá te mueras|maricón|maricones|sudaca*|"
        "filho da puta|filha da puta|filhos da puta|vai se foder|vai tomar no cu|vai à merda|vai te foder|arrombado*|"
        "пошел на хуй|пошла на хуй|иди на хуй|иди нахуй|пошел нахуй|сукин сын|чтоб ты сдох|пидор*|пидарас*|жиды|чурки|хачи"
    )),
    "curse": (1.4, (
        "asshole*|arsehole*|dickhead*|fuck|fucks|fucked|fucker*|fucking|fuckface*|shithead*|bullshit*|slut|sluts|slutty|whore|whores|bitch|bitches|twat*|wanker*|bastard*|scumbag*|douchebag*|"
        "dumbass*|jackass*|retard|retards|retarded|kiss my ass|go to hell|drop dead|deserve to die|should be exterminated|must be exterminated|should be gassed|should be hanged|should burn|rot in hell|burn in hell|piece of crap|piece of garbage|piece of trash|"
        "arschloch*|schlampe*|hure|huren|scheißkerl*|drecksau*|dreckskerl*|vollidiot*|spast|spasti|schwuchtel*|fahr zur hölle|verrecke|verrecken|"
        "connard*|connasse*|salope*|salaud*|pute|putes|putain|trou du cul|pédé|pédés|ordure|crève|ferme la|va au diable|espèce de|espèce d abruti|"
        "cabrón|cabrones|gilipollas|puta|putas|zorra|zorras|pendejo*|malparido*|vete al infierno|pedazo de basura|pedazo de mierda|muérete|hostia puta|"
        "puta|vadia|vadias|vagabunda*|caralho|cuzão|corno|desgraçado*|vai para o inferno|morre logo|cala a boca|cala essa boca|"
        "сука|суки|сучка|шлюх*|блядь|бляди|блядск*|ублюд*|мразь|мрази|хуй*|хуе*|пизд*|ебан*|ебал*|ебат*|гандон*|говнюк*|сдохни|заткнись|заткнитесь|катись к черту"
    )),
    "insult": (1.0, (
        "idiot|idiots|moron|morons|cretin|cretins|imbecile*|loser|losers|fool|fools|prick|pricks|clown|clowns|coward|cowards|pig|pigs|freak|freaks|brat|lowlife*|degenerate*|halfwit*|nitwit*|dimwit*|simpleton*|"
        "braindead|brain dead|hypocrite*|pervert*|creep|creeps|nobody likes you|everyone hates you|shut up|get lost|makes me sick|make me sick|spit on|"
        "idiot*|trottel*|depp|deppen|blödmann*|schwachkopf*|dummkopf*|penner|versager*|sau|schwein|schweine|drecksack*|feigling*|fresse|schnauze|hau ab|"
        "idiot*|abruti*|imbécile*|crétin*|débile*|bouffon*|raté|ratés|minable*|lâche|cochon|porc|gueule|dégage|casse toi|merde|merdeux|merdique|foutre|"
        "idiota*|imbécil*|estúpido*|tonto|tontos|tarado*|payaso*|cobarde*|cerdo|cerdos|inútil|asqueros*|cállate|lárgate|mierda|"
        "idiota*|imbecil*|estúpido*|burro|otário*|palhaço*|covarde*|porco|porcos|nojent*|lixo|inútil|retardado*|merda|some daqui|"
        "идиот*|дебил*|дурак*|дура|придур*|кретин*|урод*|тупица|козел|козлы|свинья|свиньи|скотин*|лох|лохи|трус|дерьм*|говно|говна|проваливай|вали отсюда"
    )),
    "scorn": (0.6, (
        "stupid*|dumb|ugly|rotten|stinking|slimy|pathetic|miserable|disgusting|filthy|dirty|worthless|useless|lazy|vile|nasty|hideous|fat|crap|shit|shitty|damn|lousy|greedy|sick|rots|rot|stink|stinks|hate you|hates you|ashamed|sewer|gutter|"
        "dumm|dumme|dummer|dummes|hässlich*|widerlich*|ekelhaft*|erbärmlich*|dreckig*|wertlos*|faul|faule|fett|fette|scheiß*|dreck|stinkend*|"
        "pauvre|sale|sales|moche|dégoûtant*|pourri*|stupide*|nul|nulle|puant*|laid|laide|honteux|"
        "asco|feo|fea|sucio|sucia|repugnante*|inmundo*|pura|miserable*|patétic*|apestos*|"
        "nojo|feio|feia|sujo|suja|repugnante*|imundo*|miserável|patétic*|fedorent*|pura|"
        "жалкий|жалкая|тупой|тупая|тупые|мерзк*|гадк*|грязн*|вонюч*|отвратительн*|ничтожн*|поганы*"
    )),
    "dehumanise": (1.0, (
        "subhuman*|vermin|scum|filth|parasite*|plague|cockroach*|rats|maggots|trash|savages|animals|leeches|infestation|breed|cage|cages|"
        "untermensch*|ungeziefer|abschaum|pack|gesindel|schmarotzer*|ratten|parasiten|"
        "vermine|racaille|parasites|rats|cafards|sous hommes|raclure*|"
        "ratas|escoria|parásitos|cucarachas|chusma|alimañas|plaga|"
        "vermes|ratos|escória|parasitas|baratas|praga|ralé|"
        "твари|тварь|тварей|отброс*|паразит*|крысы|тараканы|нелюд*|быдло|сброд"
    )),
    "violence": (0.8, (
        "kill|kill them|exterminat*|eradicat*|wiped out|wipe them out|gassed|hanged|hang|shot|shoot|beat|beats|beaten|smash|smashed|break your|choke|strangle*|stab|stabbed|slaughter*|burn|burned|lynch*|deported|cattle|camps|"
        "driven out|driven from|thrown out|kicked out|sent back|go back to|locked|should be shot|should be killed|find you|cut your|pulp|teeth|fingers|bones|skull|deserve|deserves|"
        "umbringen|abknallen|vergasen|ausrotten|ausgerottet|erschießen|erschossen|aufhängen|verbrennen|totschlagen|gejagt|abschieben|raus hier|aus dem land|"
        "tuer|crever|exterminer|éliminer|pendre|brûler|fusiller|égorger|chasser|expulser|dehors les|du pays|"
        "matar|matarlos|exterminar*|eliminar|quemar*|fusilar*|ahorcar|echarlos|expulsar*|fuera del|del país|"
        "matar|exterminar|exterminados|eliminar|queimar|fuzilar|enforcar|expulsos|expulsar|fora do|do país|"
        "убить|убивать|уничтож*|истребл*|истреб*|сжечь|повесить|расстрел*|вешать|гнать|выгнать|вон из|из страны"
    )),
    "sexual": (1.0, (
        "porn|porno|porns|pornos|pornographic|xxx|x rated|blowjob*|handjob*|cumshot*|cum|cums|cumming|pussy|pussies|cock|cocks|dick|dicks|tits|titties|boobs|clit|dildo*|gangbang*|orgasm*|horny|nudes|milf*|hardcore|masturbat*|threesome*|bukkake|"
        "legs for you|spread her legs|spread their legs|spread your legs|"
        "porno*|ficken|fickt|gefickt|titten|möpse|muschi|schwanz lutschen|wichsen|geile|geil|orgasmus|blasen|nackte weiber|"
        "porno*|baise|baiser|baisée|bite|bites|chatte|nichons|sucer|suce|bander|orgasme*|branler|partouze*|salopes|jouir|"
        "porno*|follar|follando|polla|pollas|coño|tetas|culo|mamada*|correrse|orgasmo*|cachonda*|cachondo*|"
        "pornô*|foder|fodendo|pau duro|buceta*|peitos|boquete*|gozar|orgasmo*|putaria|tesão|gostosa*|"
        "порно*|трах*|секс без|член|сиськ*|минет*|оргазм*|киск*|голые девки|голые бабы|дроч*|конч*"
    )),
    "erotic": (0.6, (
        "naked|nude|topless|sex|sexy|erotic|explicit|uncensored|moan|moans|moaned|moaning|lick|licks|licked|suck|sucks|sucked|thrust|thrusts|wet|hard|steamy|strip|strips|scream*|seduc*|singles|adults only|all night|tonight|naughty|kinky|fetish|girls|webcam|"
        "nackt*|sex|erotik*|stöhn*|leck*|lutsch*|hart|harte|heiß*|ohne ende|weiber|"
        "nu|nue|nues|nus|sexe|sexy|érotique*|gémi*|lécher|lèche|hard|chaud*|coquine*|sans tabou*|toute la nuit|filles|"
        "desnud*|sexo|sexi|erótic*|gemi*|lamer|lamió|duro|dura|caliente*|sin censura|sin límites|toda la noche|chicas|"
        "nua|nuas|nu|sexo|erótic*|gemi*|lamber|lambeu|quente*|sem censura|sem limites|a noite toda|mulheres|"
        "секс*|голы*|голая|эротич*|стон*|лизать|горяч*|без цензуры|всю ночь|девки|девушки"
    )),
    "group": (0.6, (
        "these people|those people|all of them|every one of them|every one of you|they are all|our jobs|our streets|our town|our country|our women|nothing good|never trust|women are|belong in|must be|has to be|have to be|should be|you are nothing|like cattle|like rats|"
        "alle diese|diese leute|die alle|gehören|gehört|ihr seid|raus mit|"
        "ces gens|tous les|il faut|chez nous|"
        "esa gente|todos los|sois todos|hay que|todas las|"
        "essa gente|todos os|vocês são|têm de ser|deviam ser|tem que|todas as|"
        "эти люди|все они|их надо|всех их|понаехали"
    )),
}
#: Kinds whose words can be said of things: they count in full only where somebody is meant.
OF_THINGS = ("scorn", "dehumanise", "violence", "group")
#: Kinds of which a stretch must have one; the others only add to it.
DECIDING = ("attack", "curse", "insult", "dehumanise", "sexual", "violence")

#: Erotic words of a stretch that decide without any other.
EROTIC_WORDS = 3

# Words that show somebody to be meant.
MEANT = (
    "you|your|yours|yourself|u|ur|they|them|their|theirs|these|those|he|him|his|she|her|who|are|all|every|everyone|nobody|women|men|people|what a|i hope|that|this|"
    "du|dich|dir|dein|deine|ihr|euch|sie|die alle|alle|diese|wer|sind|bist|tu|toi|te|ton|ta|vous|votre|ils|elles|ces|tous|toutes|sont|es|espèce|sale|"
    "tú|tu|te|ti|usted|vosotros|ellos|ellas|esos|estos|todos|todas|son|eres|você|vocês|seu|sua|eles|elas|esses|são|é um|é uma|"
    "ты|тебя|тебе|твой|твоя|вы|вас|ваш|они|их|все|эти|он|она"
)

# Phrases in which such words are harmless; they cover their own words only.
EXCEPTIONS = (
    "great tit*|blue tit*|coal tit*|marsh tit*|mole rat*|naked eye|naked mole|naked truth|breast cancer|cancer screening|sexual health|sex education|sex ratio|sex and postcode|same sex|sex differences|safe sex|"
    "cock a doodle|cock and bull|weathercock*|moby dick|dick tracy|kill the process|kill a process|kill the child|kill the worker|killed by the kernel|kill switch|kill time|master slave|dead code|hard drive*|hard disk*|hard copy|hard coded|"
    "wet season|wet weather|wet ground|wet wood|dirty data|dirty page*|dirty read*|dirty bit|dirty cache|dumb terminal*|dummy|ugly duckling|fat client|fat binary|garbage collect*|trash can|trash bin|guinea pig*|pig iron|bull terrier|"
    "screaming frog|sucking insects|beats per minute|heart beats|beat the drum|burn rate|burn time|slow burn|shot peening|screen shot*|moon shot*|photo shoot|nude statue*|nude painting*|nude study|"
    "nackte statue*|nackter oberkörper|nackte zahlen|sexualkunde|sexuelle gesundheit|statues nues|nu artistique|santé sexuelle|éducation sexuelle|estatuas desnudas|salud sexual|educación sexual|estátuas nuas|saúde sexual|educação sexual|"
    "сексуальное здоровье|половое воспитание|обнаженная статуя"
)

# Words that announce a mention of such words, or of somebody else's speech.
MENTIONS = (
    "words like|words such as|the word|the words|terms like|terms such as|the term|blocked words|list of words|banned words|offensive words|swear words|slurs like|slurs such as|insults like|insults such as|calling someone|calling people|to call someone|called him|called her|"
    "villain shouts|villain says|villain calls|character shouts|character says|shouts|shouted|quoted as|the insult|hate speech|"
    "wörter wie|begriffe wie|das wort|der begriff|ausdrücke wie|schimpfwörter|mots comme|mots tels que|le mot|termes comme|expressions comme|palabras como|la palabra|términos como|expresiones como|"
    "palavras como|a palavra|termos como|expressões como|слова вроде|слово|слова типа|слова как|выражения вроде"
)

# Letters of other alphabets that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeiknoptux", strict=True))
SIGNS = dict(zip("0134578@$€", "oieastbase", strict=True))

_BREAK = "|"
_WORD_OR_BREAK = re.compile(r"\w+|[.!?…\n]+")
_SPELT = re.compile(r"(?<!\w)[^\W\d_]([ .\-_·*])[^\W\d_](?:\1[^\W\d_])*\1[^\W\d_]{1,3}(?!\w)")
_SIGNED = re.compile(r"(?<![\w@$€])[^\W\d_]*[0-9@$€][\w@$€]*")
_MIXED = re.compile(r"\w*(?:[a-zß-ÿ][Ͱ-ԯ]|[Ͱ-ԯ][a-zß-ÿ])\w*")
_STARRED = re.compile(r"(?<![\w*])(\w+)(\*+)(\w*)(?![\w*])")
_STRETCHED = re.compile(r"(\w)\1\1+")
_LATIN = re.compile(r"[a-zß-ÿ]")


def _accents() -> dict[int, str]:
    table = {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("’"): " ", ord("'"): " ", ord("­"): "", ord("​"): "", ord("‍"): ""}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        bare = "".join(c for c in parts if not unicodedata.combining(c)).lower()
        if bare != chr(code) and code not in table:
            table[code] = bare
    for code in range(0x300, 0x370):
        table[code] = ""
    return table


_ACCENTS = _accents()


def _unmix(m: re.Match) -> str:
    word = m[0]
    if 2 * len(_LATIN.findall(word)) >= len(word):
        return "".join(LOOKALIKES.get(c, c) for c in word)
    back = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k < "԰"}
    return "".join(back.get(c, c) for c in word)


class Lexicon:
    """The folded lexicon as an automaton, with the means to fold texts the same way."""

    def __init__(self):
        self.words: dict[int, list[str]] = {}
        self.names: list[str] = []
        self.kinds: list[str] = []
        start: list[float] = []
        numbers: dict[str, int] = {}
        entries: dict[str, tuple[str, int]] = {}
        for kind, (weight, listed) in LEXICON.items():
            for entry in listed.split("|"):
                name = _folded_entry(entry)
                if name not in numbers:  # of two kinds the first counts
                    numbers[name] = len(self.names)
                    self.names.append(name)
                    self.kinds.append(kind)
                    start.append(weight)
                    self._enter(entries, entry, ("hit", numbers[name]))
        for entry in EXCEPTIONS.split("|"):
            self._enter(entries, entry, ("safe", 0))
        for entry in MENTIONS.split("|"):
            self._enter(entries, entry, ("mention", 0))
        for entry in MEANT.split("|"):
            key = f" {_folded_entry(entry)} "
            kind, number = entries.get(key, ("meant", -1))
            entries[key] = (kind, number)
        self.meant = {_folded_entry(m) for m in MEANT.split("|")}
        self.start = np.array(start)
        self.of_things = np.array([k in OF_THINGS for k in self.kinds])
        self.deciding = np.array([k in DECIDING for k in self.kinds])
        self.automaton = ahocorasick.Automaton()
        for key, value in entries.items():
            self.automaton.add_word(key, (len(key), *value))
        self.automaton.make_automaton()

    def _enter(self, entries: dict, entry: str, value: tuple[str, int]) -> None:
        open_ = entry.endswith("*")
        folded = _folded_entry(entry)
        for form in {folded, re.sub(r"(\w)\1", r"\1", folded)}:
            if form != folded and (" " not in form and len(form) < 5):
                continue
            entries.setdefault(f" {form}" if open_ else f" {form} ", value)
        if value[0] == "hit":
            for word in folded.split():
                if len(word) > 2 and word not in self.words.setdefault(len(word), []):
                    self.words[len(word)].append(word)

    def _unstar(self, m: re.Match) -> str:
        head, stars, tail = m.groups()
        size = len(m[0])
        fits = [w for w in self.words.get(size, ()) if w.startswith(head) and w.endswith(tail)]
        return fits[0] if fits else m[0]

    def fold(self, text: str) -> str:
        """Lower-case words with breaks between sentences, all evasions undone."""
        low = text.lower()
        if not low.isascii():
            low = low.translate(_ACCENTS)
            if _MIXED.search(low):
                low = _MIXED.sub(_unmix, low)
        low = _SPELT.sub(lambda m: m[0].replace(m[1], ""), low)
        low = _SIGNED.sub(_unsign, low)
        if "*" in low:
            low = _STARRED.sub(self._unstar, low)
        low = _STRETCHED.sub(r"\1", low)
        words = [w if w[0].isalnum() or w[0] == "_" else _BREAK for w in _WORD_OR_BREAK.findall(low)]
        return " " + " ".join(words) + " "

    def stretches(self, text: str) -> tuple[list[list[tuple[int, float]]], int]:
        """``(stretches, words)``: of every stretch that begins at a hit, its entries with the share of their weight that counts."""
        folded = self.fold(text)
        found: dict[str, list[tuple[int, int, int]]] = {"hit": [], "safe": [], "mention": [], "meant": []}
        for end, (size, kind, number) in self.automaton.iter(folded):
            found[kind].append((end - size + 1, end, number))
        total = folded.count(" ") - 1
        if not self._decides({n for _, _, n in found["hit"]}):
            return [], total
        meant = sorted(x[0] for x in found["meant"]) + [x[0] for x in found["hit"] if self.names[x[2]].split()[0] in self.meant]
        word_at = np.cumsum(np.frombuffer(folded.encode("utf-32-le"), np.uint32) == 32)
        breaks = np.array([m.start() for m in re.finditer(re.escape(f" {_BREAK} "), folded)] + [len(folded)])
        sentence = lambda at: int(np.searchsorted(breaks, at))
        meant_words = [(sentence(at), int(word_at[at])) for at in meant]
        mention_words = [(sentence(at), int(word_at[at]), int(word_at[min(end, len(word_at) - 1)])) for at, end, _ in found["mention"]]
        safe = [(at, end) for at, end, _ in found["safe"]]
        counted: list[tuple[int, int, int, float]] = []
        covered = -1
        for at, end, number in sorted(found["hit"], key=lambda h: (h[0], -h[1])):  # a phrase takes the place of its words
            if end <= covered + 1 or any(lo <= at < hi for lo, hi in safe):
                continue
            covered = max(covered, end - 1)
            s, w = sentence(at), int(word_at[at])
            share = 1.0
            if self.of_things[number] and not any(s == t and abs(w - v) <= MEANT_WORDS for t, v in meant_words):
                share = NOBODY
            if any(s == t and (0 <= w - hi <= MENTION_WORDS or 0 < lo - w <= 1) for t, lo, hi in mention_words):
                share *= MENTIONED
            counted.append((s, w, number, share))
        out = []
        for k, (s, w, _, _) in enumerate(counted):
            inside = [x for x in counted[k:] if x[0] == s and x[1] - w < STRETCH_WORDS]
            best: dict[int, float] = {}
            for _, _, number, share in inside:  # a repeated entry counts once
                best[number] = max(best.get(number, 0.0), share)
            span = inside[-1][1] - w + 1
            scale = min(1.0, FREE_WORDS / span)
            if self._decides(best):
                out.append([(n, x * scale) for n, x in best.items()])
        return out, total

    def _decides(self, numbers) -> bool:
        """A word of a deciding kind, or so many erotic ones."""
        return any(self.deciding[n] for n in numbers) or sum(self.kinds[n] == "erotic" for n in numbers) >= EROTIC_WORDS

    def judge(self, text: str, weights: np.ndarray | None = None) -> tuple[float, float, list[str]]:
        """Best stretch's weight, weight in a hundred words, and the terms of the best stretch."""
        weights = self.start if weights is None else weights
        found, total = self.stretches(text)
        if not found:
            return 0.0, 0.0, []
        sums = [sum(weights[n] * x for n, x in s) for s in found]
        k = int(np.argmax(sums))
        every = {n: max(x for s in found for m, x in s if m == n) for s in found for n, _ in s}
        density = 100 * sum(weights[n] * x for n, x in every.items()) / max(1, total)
        return float(sums[k]), float(density), [self.names[n] for n, _ in found[k]]


def _folded_entry(entry: str) -> str:
    return " ".join(re.findall(r"\w+", entry.rstrip("*").lower().translate(_ACCENTS)))


def _unsign(m: re.Match) -> str:
    word = m[0]
    return "".join(SIGNS.get(c, c) for c in word) if any(c.isalpha() for c in word) else word


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


def _text(title: str | None, body: str | None) -> str:
    return f"{title or ''}\n{body or ''}"


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for title, body in zip(batch.column("title").to_pylist(), batch.column("content_text").to_pylist(), strict=True):
        yield _text(title, body)


def majority(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of documents on which most annotators agree; repeated rows count once, nulls and ties not at all."""
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").distinct().groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).alias("toxic"))


def _labelled_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lexicon()
    for batch in batches:
        rows = []
        for doc, toxic, text in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), _texts(batch), strict=True):
            for s in known.stretches(text)[0]:
                rows.append((doc, toxic, [n for n, _ in s], [x for _, x in s]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "toxic", "entries", "shares"])


def fitted_weights(docs: DataFrame, labels: DataFrame | None, at_most: int = SAMPLE_LABELS) -> np.ndarray:
    """The lexicon's weights, fitted to at most ``at_most`` labelled documents; as written without any.

    Logistic regression of the majority label on the best stretch of each document, which
    is chosen anew as weights change; weights are held at their start.
    """
    known = lexicon()
    if labels is None:
        return known.start
    sample = majority(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    asked = docs.select("doc_id", "title", "content_text").join(F.broadcast(sample), "doc_id")  # at_most rows
    rows = asked.mapInArrow(_labelled_stretches, "doc_id bigint, toxic boolean, entries array<int>, shares array<double>").toPandas()
    if not len(rows):
        return known.start
    matrix = np.zeros((len(rows), len(known.start)))
    for k, (entries, shares) in enumerate(zip(rows["entries"], rows["shares"], strict=True)):
        matrix[k, list(entries)] = shares
    doc, first = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    toxic = np.zeros(len(doc))
    toxic[first] = rows["toxic"].to_numpy(bool)
    weights = known.start.copy()
    for _ in range(FIT_STEPS):
        score = matrix @ weights
        order = np.lexsort((score, first))
        best = order[np.r_[np.flatnonzero(np.diff(first[order])), len(order) - 1]]
        p = 1 / (1 + np.exp(-STEEPNESS * (score[best] - THRESHOLD)))
        seen = ERRORS + (1 - 2 * ERRORS) * p  # the label that annotators would give
        pull = (seen - toxic) / (seen * (1 - seen)) * (1 - 2 * ERRORS) * p * (1 - p)
        slope = STEEPNESS * (pull @ matrix[best]) + HOLD * (weights - known.start)
        weights = np.clip(weights - 0.02 * slope / (1 + 0.02 * HOLD), 0.0, 3.0)
    return weights


def _scorer(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon()
        for batch in batches:
            rows = [known.judge(text, weights.value) for text in _texts(batch)]
            score, density, terms = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(density, pa.float64()), pa.array(terms, pa.list_(pa.string()))],
                [batch.schema.names[0], "score", "density", "terms"],
            )

    return run


def abuse_scores(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, score, density, terms`` of every row: best stretch, weight in a hundred words, terms of that stretch.

    ``labels`` (``doc_id, toxic``): judgements that the weights are fitted to. Null and
    empty texts score 0. Titles count as a line of their own.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fitted_weights(docs, labels))
    return docs.select("doc_id", "title", "content_text").mapInArrow(_scorer(weights), SCORE_SCHEMA)


def abusive_documents(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    return abuse_scores(docs, labels).where(F.col("doc_id").isNotNull() & (F.col("score") >= threshold)).select("doc_id")


def site_rates(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``site, documents, abusive, rate`` by host of ``url``; documents without one have a null site."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted_weights(docs, labels))
    asked = docs.select(canonical_host(F.col("url")).alias("site"), "title", "content_text")
    judged = asked.mapInArrow(_scorer(weights), "site string, score double, density double, terms array<string>")
    bad = F.sum((F.col("score") >= threshold).cast("long"))
    return judged.groupBy("site").agg(F.count("*").alias("documents"), bad.alias("abusive"), F.round(bad / F.count("*"), 6).alias("rate"))
