"""Wording of what a site's software leaves or sends in place of an article.

Rules for one line of a page: unfilled placeholders, filler text, error messages, notices that scripts, cookies
or a browser check are needed. ``mask`` takes out of a line what differs between copies of one message.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from itertools import chain

from .furniture import has_digit

# Names that templates give to their fields.
FIELDS = (
    "title|subtitle|headline|name|first_name|last_name|full_name|username|user|author|email|e_mail|phone|date|time|year|price|amount|total|currency|stock|sku|product|product_name|item"
    "|category|tag|tags|summary|description|excerpt|body|content|text|count|number|quantity|city|region|country|state|street|address|zip|url|link|image|image_url|company|company_name|id|order_id"
)
_F = f"(?:{FIELDS})"
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.$ |'-]{1,60}?\s*\}?\}\}|<%[=-]?\s*[\w.@()\[\]'\" -]{1,60}?\s*-?%>|\{%-?\s*[\w.'\" =|-]{1,60}?-?%\}|\$\{\s*[\w.]{1,60}\s*\}|#\{\s*[\w.]{1,60}\s*\}"
    r"|\$\$[A-Za-z_]\w{0,40}\$\$|\[\[\s*[A-Za-z_][\w. -]{0,40}\s*\]\]|@Model\.\w+|(?<!\w)%[A-Z][A-Z_]{2,40}%|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)"
    r"|\[(?:INSERT|YOUR|ENTER|ADD)\b[A-Z_ ]{1,40}\]"
    rf"|\[(?:{FIELDS.upper()})\]|(?<![\w$#{{]){{{_F}}}(?!}})|<(?:insert |your )?{_F}(?: [a-z]+)? (?:goes )?here>"
)
#: Two characters as every placeholder begins; a quick test, so it starts with a set of characters.
_HINT = re.compile(r"[{\[$%<@_#][{%A-Za-z=\[$_]")
#: A sentence that speaks of templates names both the thing and its marks.
_TALK = re.compile(r"\b(?:templates?|modèles?|gabarits?|plantillas?|vorlagen?|modelos?|modell[oi]|шаблон\w*)\b", re.I)
_MARKS = re.compile(r"\b(?:braces|brackets|curly|accolades|crochets|llaves|corchetes|klammern|chavetas|chaves|colchetes|graffe|parentesi|скобк\w*|placeholders?|percent signs)\b", re.I)
_QUOTED = re.compile(r"[“«„\"‘'‹`(]\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[”»“\"’)]*\s+")

# Words of the usual filler text; only the start, further words are learned from the corpus.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore magna aliqua veniam nostrud exercitation ullamco laboris aliquip commodo consequat irure
    reprehenderit voluptate cillum fugiat pariatur excepteur occaecat cupidatat proident officia deserunt mollit laborum vestibulum pellentesque mauris vivamus praesent donec""".split()
)
# Frequent function words of the seven languages.
FUNCTION = frozenset(
    """the of and to in a is that for on with as by at from it was were are be this which an or not but had has have its their after before since while although because so near behind under during without
    el la los las de del y en un una por con para que se su sus lo al como más pero desde sin sobre entre tras hasta aunque mientras porque durante junto cerca detrás
    le les des du et une dans pour par sur avec sans au aux ce qui que est sont a été plus mais son sa ses leur depuis après avant pendant chez près derrière sous
    der die das den dem des ein eine einen einem einer und in im zu von mit auf für ist nicht sich bei aus nach vor seit während obwohl weil unter neben über am zum zur hinter ohne gegen
    o os as um uma de do da dos das em no na nos nas por com para que se seu sua mais mas desde sem sobre entre atrás ao aos à durante depois antes enquanto embora porque junto perto
    il lo gli i un uno una di del della dei delle e in con per che non si su sul sulla da dal dalla al alla come più ma dopo prima durante senza sotto dietro vicino mentre anche perché nel nella
    и в во не на с со к по за из от для что как но а у о об под над при до без после через между хотя потому пока это его её их возле около""".split()
)
# Filler phrases that editors and themes leave behind.
FILLER = re.compile(
    r"^(?:description coming soon|short description of the product goes in this place|(?:your )?(?:text|content) (?:goes )?here|your content here|sample (?:heading|text|page)|hello world! welcome to|texte provisoire|beispieltext"
    r"|blindtext|texto de (?:ejemplo|exemplo|prueba)|texto provis[oó]rio|testo (?:di esempio|provvisorio|segnaposto)|текст[ -](?:заглушка|пример)|пример текста|здесь будет|platzhalter|todo\b|xxx\b|asdf\b|tbd\b"
    r"|placeholder|click (?:here )?to edit|this is (?:a )?(?:sample|placeholder|dummy))",
    re.I,
)

# Phrases of error messages in place of a page.
ERROR_PHRASES = """
page you are looking for|page you requested|page cannot be found|page cannot be displayed|may have been moved or never existed|link seems to be broken|service unavailable|service temporarily unavailable
internal server error|bad gateway|gateway timeout|gateway time-out|upstream request timeout|error establishing a database|something went wrong|be right back|scheduled maintenance|down for maintenance
account has been suspended|contact your hosting provider|access denied|access is denied|do not have permission|under maintenance|be back soon|be back shortly|try again later|try again in a few|please try again
página solicitada|página no encontrada|página que busca|no existe o ha cambiado|sitio en mantenimiento|volvemos enseguida|acceso denegado|no tiene permiso|algo ha fallado|inténtelo de nuevo|error interno|página en mantenimiento
page demandée|page introuvable|introuvable ou a été|site en maintenance|nous revenons|accès refusé|accès interdit|pas le droit de consulter|erreur interne|merci de réessayer|veuillez réessayer
angeforderte seite|seite wurde nicht gefunden|seite nicht gefunden|wartungsarbeiten|wir sind gleich wieder|zugriff verweigert|dürfen diese seite nicht|interner serverfehler|versuchen sie es später|versuchen sie es in einigen|versuchen sie es bitte
página que procura|página não encontrada|não existe ou mudou|em manutenção|voltamos já|voltamos em breve|voltamos dentro|acesso negado|não tem permissão|erro interno|tente novamente
pagina cercata|pagina richiesta|pagina non trovata|non esiste o è stata|sito in manutenzione|torniamo subito|torniamo presto|torneremo|accesso negato|non hai i permessi|errore interno|riprova tra|riprova più|qualcosa è andato
страница не найдена|запрошенная страница|не найдена или перемещена|технические работы|технических работ|сайт на обслуживании|скоро вернёмся|мы скоро|доступ запрещён|нет прав на просмотр|внутренняя ошибка|повторите попытку"""
# Phrases of notices that scripts, cookies or a browser check are needed.
SCRIPT_PHRASES = """
javascript|needs scripts|require scripts|requires scripts|required scripts|scripts to be turned on|scripts to be enabled|blocks scripts|scripts and cookies|scripts or cookies|reload the page once|checking your browser|process is automatic
you will be redirected|enable scripts|enable cookies|cookies are required|cookies are enabled|cookies are disabled|cookies must be required|cookies must be enabled|cookies must be disabled
necesita scripts|recargue la página|active las cookies|comprobando su navegador|se le redirigirá|proceso es automático
besoin de scripts|rechargez la page|vérification de votre navigateur|serez redirigé
benötigt skripte|laden sie die seite neu|überprüfen ihren browser|überprüft ihren browser|überprüfung ihren browser|browser wird geprüft|browser wird überprüft|weitergeleitet
precisa de scripts|recarregue a página|a verificar o seu navegador|será redirecionado
bisogno degli script|ricarica la pagina|ricaricare la pagina|verifica del browser|controllo del browser|sarai reindirizzato
разрешить скрипты|перезагрузите страницу|обновите страницу|проверка браузера|проверяем ваш браузер|будете перенаправлены"""
#: Whole lines: codes with or without their wording, and addresses with a status.
_BARE = re.compile(
    r"(?:http )?(?:error|erreur|errore|erro|fehler|ошибка) ?\d{3}\b.{0,40}|[45]\d\d(?:\W+[a-zà-ÿ ]{0,60})?|(?:https?:/)?/\S*\W+http [1-5]\d\d\W*|(?:[45]\d\d )?(?:page )?not found\W*",
    re.I,
)
_BARE_END = re.compile(r"^(?:.{0,40}\W)?(?:nothing here|forbidden)\W*$")
_AUTOMATA: list = []


def _phrases():
    """One automaton for all phrases; each ends with its kind. Built once a worker."""
    if not _AUTOMATA:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, phrases in (("error", ERROR_PHRASES), ("script", SCRIPT_PHRASES)):
            for phrase in phrases.replace("\n", "|").split("|"):
                if phrase:
                    found.add_word(phrase, kind)
        found.make_automaton()
        _AUTOMATA.append(found)
    return _AUTOMATA[0]


_REF = re.compile(r"\((?:ref|id|ray id|request)\W{0,2}\s*[\w-]+\)", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+")
_PATH = re.compile(r"(?<!\S)/[\w./%~-]{3,}")
_MAIL = re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.]+")
_NUMBERED = re.compile(r"\b\d+-[^\W\d_]+(?:-[^\W\d_]+)*\b")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b|\b\d{1,2}:\d\d(?::\d\d)?\b")
_DATE_HINT = re.compile(r"[0-9][./:-][0-9]")
_NUM = re.compile(r"[0-9]+")


def mask(line: str, low: str | None = None) -> str:
    """A squeezed line without references, addresses, dates and numbers, in lower case; ``low`` is the line in lower case."""
    given = line
    if "(" in line:
        line = _REF.sub("", line)
    if "://" in line or "www." in line:
        line = _URL.sub("<a>", line)
    if "/" in line:
        line = _PATH.sub("<a>", line)
    if "@" in line:
        line = _MAIL.sub("<a>", line)
    if has_digit(line):
        if "-" in line:
            line = _NUMBERED.sub("<a>", line)
        if _DATE_HINT.search(line):
            line = _DATE.sub("<d>", line)
        line = _NUM.sub("0", line)
    return (low or line.lower()) if line is given else " ".join(line.lower().split())


_MASKED = re.compile(r"<[ad]>")
_LETTERS = re.compile(r"[^\W\d_]+")
_TWO_WORDS = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")


def worded(masked: str) -> bool:
    """Does a masked line still say something: two words or eight letters?"""
    if "<" in masked:
        masked = _MASKED.sub(" ", masked)
    return _TWO_WORDS.search(masked) is not None or sum(map(len, _LETTERS.findall(masked))) >= 8


def unfilled(text: str) -> bool:
    """Does the text hold a placeholder that isn't the subject of a sentence on templates, nor quoted?"""
    if _HINT.search(text) is None:
        return False
    for line in text.split("\n"):
        if _HINT.search(line) is None or PLACEHOLDER.search(line) is None:
            continue
        for sentence in _SENTENCE.split(line):
            spared = bool(_TALK.search(sentence) and _MARKS.search(sentence))
            for m in PLACEHOLDER.finditer(sentence):
                if spared and m.group()[0] == "{":
                    spared = False  # the one that the sentence is about
                    continue
                before, after = sentence[: m.start()], sentence[m.end() :]
                if _QUOTED.search(before) and re.match(r"\s*[”»“\"’'›`)]", after) and before.rstrip()[-1:] not in "(":
                    continue
                return True
    return False


def _bare_words(line: str) -> list[str]:
    return [w.strip(".,;:!?") for w in line.lower().split()]


def _latin(words: list[str]) -> bool:
    """Two words of the usual filler text, and hardly any function word."""
    return len(FILLER_WORDS.intersection(words)) >= 2 and sum(map(FUNCTION.__contains__, words)) < 0.15 * len(words)


#: Rounds in which filler words are learned, at most.
LEARN_ROUNDS = 4
#: Different words that one worker counts before it hands them on; it bounds memory and changes no result.
COUNTED_WORDS = 200_000


def _wordy(words: list[str]) -> bool:
    """May a line of these words be filler: eight words or more, hardly any function word?"""
    return len(words) >= 8 and sum(map(FUNCTION.__contains__, words)) < 0.15 * len(words)


def _inside(words: list[str], known: Collection[str]) -> bool:
    return _latin(words) or 2 * sum(w in known for w in words) >= len(words)


def learn_filler(lines: Iterable[str], rounds: int = LEARN_ROUNDS) -> frozenset[str]:
    """Vocabulary of the corpus' filler text, grown from FILLER_WORDS.

    A line of eight words or more with hardly any function word is filler when it holds two of the words at first
    known, or half of its words are known by now; words that stand in such lines nearly always are learned.
    ``screen.filler_words`` does the same over a table.
    """
    coded: list[list[str]] = []
    every: Counter[str] = Counter()
    for line in lines:
        words = _bare_words(line)
        every.update(words)
        if _wordy(words) and all(w.isalpha() for w in words):
            coded.append(words)
    known: set[str] = set(FILLER_WORDS)
    for _ in range(rounds):
        inside: Counter[str] = Counter()
        for words in coded:
            if _inside(words, known):
                inside.update(words)
        more = {w for w, c in inside.items() if c >= 2 and c >= 0.8 * every[w] and w not in FUNCTION}
        if more <= known:
            break
        known |= more
    return frozenset(known)


def count_words(contents: Iterable[str]) -> Iterator[tuple[Counter[str], Counter[str]]]:
    """Counts of the words that may be learned and of the lines that may be filler, their words joined by spaces."""
    rough: Counter[str] = Counter()
    coded: Counter[str] = Counter()

    def bare() -> Counter[str]:
        words: Counter[str] = Counter()
        for t, n in rough.items():
            w = t.strip(".,;:!?")
            if w.isalpha() and w not in FUNCTION:
                words[w] += n
        return words

    for content in contents:
        lines = [x.split() for x in content.lower().split("\n")]
        rough.update(chain.from_iterable(lines))
        for line in lines:
            # Signs at the words only hide function words, so that few lines need a closer look.
            if _wordy(line):
                words = [w.strip(".,;:!?") for w in line]
                if _wordy(words) and all(map(str.isalpha, words)):
                    coded[" ".join(words)] += 1
        if len(rough) + len(coded) > COUNTED_WORDS:
            yield bare(), coded
            rough, coded = Counter(), Counter()
    yield bare(), coded


def count_inside(lines: Iterable[tuple[str, int]], known: Collection[str]) -> Counter[str]:
    """Words of the filler among (line, how often) of ``count_words``."""
    inside: Counter[str] = Counter()
    for line, n in lines:
        words = line.split(" ")
        if _inside(words, known):
            for w in words:
                inside[w] += n
    return inside


def message(line: str, filler: frozenset[str] = FILLER_WORDS, low: str | None = None, rough: list[str] | None = None) -> str:
    """'error', 'script', 'filler' or '' for one squeezed main line, of any length.

    An error or a notice has its phrase in at least a third of the line's sentences. ``low`` and ``rough`` are the
    line in lower case and its words, where the caller has them.
    """
    low = line.lower() if low is None else low
    rough = low.split() if rough is None else rough
    # Lines without a single such word, as they stand between spaces, need no closer look unless most words end in a sign.
    if len(rough) >= 4 and (not filler.isdisjoint(rough) or 2 * (low.count(",") + low.count(";") + low.count(".")) >= len(rough)):
        words = _bare_words(line)
        if sum(map(filler.__contains__, words)) >= 0.7 * len(words) or _latin(words):
            return "filler"
    if FILLER.match(low):
        return "filler"
    if "(" in line:
        low = _REF.sub("", low).strip()
    if _BARE.fullmatch(low) or ("nothing here" in low or "forbidden" in low) and _BARE_END.search(low):
        return "error"
    hit = next(_phrases().iter(low), None)
    if hit is None:
        return ""
    sentences = _SENTENCE.split(low)
    hits = [h[1] for h in (next(_phrases().iter(x), None) for x in sentences) if h]
    if len(hits) * 3 < len(sentences):
        return ""
    return "error" if "error" in hits else "script" if hits else hit[1]
