"""What kind of line is it: shared rules for the furniture of web pages.

``kinds(lines, domain)`` names each line of a page: '' for anything that may be main content, else one of
blank, nav, cookie, byline, share, letter (newsletter), legal, foot, head (heading of a list of pointers),
point (pointer to another article). The rules know the wording of seven languages; they read lines whose
encoding was broken through ``untangle`` first.
"""

from __future__ import annotations

import re

from .encodings import untangle

# Names of navigation entries in the seven languages.
NAV = {
    w.strip().lower()
    for w in """
    Home|News|Archive|Contact|About us|Help|Search|Sign in|Log in|Login|Shop|Gallery|Events|Jobs|Forum|Travel|Weather|Recipes|Guides|Reviews|Support|Menu|Register|Blog
    Inicio|Noticias|Archivo|Contacto|Quiénes somos|Ayuda|Buscar|Iniciar sesión|Tienda|Galería|Agenda|Empleo|Foro|Viajes|El tiempo|Recetas|Guías|Reseñas|Menú
    Accueil|Actualités|Archives|Contact|À propos|Aide|Recherche|Connexion|Boutique|Galerie|Agenda|Emploi|Forum|Voyages|Météo|Recettes|Guides|Critiques
    Startseite|Nachrichten|Archiv|Kontakt|Über uns|Hilfe|Suche|Anmelden|Laden|Galerie|Termine|Stellen|Forum|Reisen|Wetter|Rezepte|Ratgeber|Tests
    Início|Notícias|Arquivo|Contactos|Contatos|Quem somos|Ajuda|Pesquisar|Entrar|Loja|Galeria|Agenda|Emprego|Fórum|Viagens|Tempo|Receitas|Guias|Análises
    Pagina iniziale|Notizie|Archivio|Contatti|Chi siamo|Aiuto|Cerca|Accedi|Negozio|Galleria|Eventi|Lavoro|Forum|Viaggi|Meteo|Ricette|Guide|Recensioni
    Главная|Новости|Архив|Контакты|О нас|Помощь|Поиск|Войти|Магазин|Галерея|События|Вакансии|Форум|Поездки|Погода|Рецепты|Советы|Обзоры
    """.replace("\n", "|").split("|")
    if w.strip()
}
NAV |= {re.sub(r"[^\x00-\x7f]", "\ufffd", w) for w in NAV}
_NAV_SORTED = sorted(NAV, key=len, reverse=True)
_NAV_RUN = re.compile(r"(?:%s)(?:\s+(?:%s))*" % (("|".join(map(re.escape, _NAV_SORTED)),) * 2))
_SEPARATORS = frozenset("|»·/•›>\ufffd")
_NAV_FIRST = frozenset(w.split()[0] for w in NAV)
_PARTS = re.compile(r"\s*(?:[|»·/•›>]|\s\ufffd\s)\s*")

# Wording of notices, prompts and list headings.
_COOKIE = re.compile(
    r"\bcookies?\b.{0,90}(?:settings|préférences|réglages|visit|visite|besuche|preferenc|impostazioni|настройк|ajustes|einstellungen|accept|aceptar|zustimm)"
    r"|we value your privacy|respetamos su privacidad|respectons votre vie privée|ihre privatsphäre ist uns|respeitamos a sua privacidade|tua privacy è importante|vostra privacy|ценим вашу конфиденциальность|файлы cookie",
    re.I,
)
_BYLINE = re.compile(r"(?:By|Por|Par|Von|Di|Автор:?|Text:|Texto:|Foto:|Fotos?:)\s+[A-ZА-ЯЁÀ-Þ][\w’'-]+(?:\s+(?:[A-ZА-ЯЁÀ-Þ][\w’'.-]*|de|da|van|von|del|di)){0,4}\s*(?:[,·|–—-].*)?$")
_BYTAIL = re.compile(r"#\d+\s*$|\b\d{1,3}\s*(?:min\b|Min\.|мин)|\d{1,2}[:.]\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d\d-\d\d")
_SHARE = re.compile(
    r"^(?:share this|comparte esta|teilen sie (?:diesen|den)|partagez cet|partilhe esta|compartilhe est|condividi quest|поделитесь этой|did you like this|te ha gustado|¿te ha gustado|hat es ihnen gefallen|cela vous a plu|gostou\?|ti è piaciuto|понравилось\?)",
    re.I,
)
_LETTER = re.compile(
    r"newsletter|weekly digest|suscríbete al boletín|no te pierdas nada|resumen semanal|abonnieren sie|wochenübersicht|nichts mehr verpassen|abonnez-vous|résumé hebdomadaire|ne manquez rien|assine o boletim|resumo semanal|não perca nada|iscriviti alla|riassunto settimanale|non perderti nulla|подпишитесь на|еженедельный обзор|ничего не пропустите",
    re.I,
)
_LEGAL = re.compile(
    r"all rights reserved|todos los derechos reservados|tous droits réservés|alle rechte vorbehalten|todos os direitos reservados|tutti i diritti riservati|все права защищены"
    r"|without warranty of any kind|se ofrece sin garantía|sont données sans garantie|erfolgen ohne gewähr|é dada sem qualquer garantia|sono fornite senza alcuna garanzia|без каких-либо гарантий",
    re.I,
)
_FOOT = re.compile(r"^\ufffd \S.* (?:19|20)\d\d\b|^(?:©|\(c\)\s|copyright\b)|\b(?:imprint|aviso legal|impressum|mentions légales|ficha técnica|note legali|выходные данные)\s*[–|·-]", re.I)
_HEAD = re.compile(
    r"^(?:popular this week|most read today|you may also like|related (?:articles|stories)|read (?:also|next|more)|lo más (?:visto|leído)(?: de la semana| hoy)?|también te puede interesar"
    r"|les plus (?:lus|vus) (?:du jour|de la semaine)|vous aimerez aussi|heute meistgelesen|beliebt in dieser woche|das könnte sie auch interessieren"
    r"|as mais (?:lidas|vistas) (?:de hoje|da semana)|também pode gostar de|i più (?:letti|visti) (?:di oggi|della settimana)|potrebbe interessarti anche"
    r"|популярное за неделю|самое читаемое сегодня|вам также понравится)\s*:?$",
    re.I,
)
_INLINE = re.compile(
    r"^(?:read also|see also|read more|related|más información|lea también|lee también|ver también|leia também|veja também|lire aussi|à lire aussi|voir aussi|lesen sie auch|siehe auch|mehr dazu|leggi anche|vedi anche|читайте также|см\. также|zum thema|véase también|relacionado|correlati|sullo stesso tema|sur le même sujet|по теме|on this topic|sobre este tema|related stor(?:y|ies))\s*:",
    re.I,
)
_SPACE = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"[.!?…;:][\"'”’»“)\]]*$")


def _lossy(pattern: re.Pattern[str]) -> re.Pattern[str]:
    """The same wording with replacement characters in place of non-ASCII letters."""
    return re.compile("".join(c if c.isascii() else f"[{c}\ufffd]" for c in pattern.pattern), pattern.flags)


_COOKIE, _SHARE, _LETTER, _LEGAL, _HEAD, _INLINE = map(_lossy, (_COOKIE, _SHARE, _LETTER, _LEGAL, _HEAD, _INLINE))
def squeeze(line: str) -> str:
    """Runs of white space become one space; the ends are trimmed."""
    return " ".join(line.split())


def is_nav(s: str, site: str = "") -> bool:
    low = s.lower().strip(" *-–•·»|›")
    if low in NAV:
        return True
    if len(low) > 240:
        return False
    parts = [p for p in _PARTS.split(low) if p] if not _SEPARATORS.isdisjoint(low) else ()
    if len(parts) > 1:
        known = sum(p in NAV or p == site for p in parts)
        return known * 3 >= len(parts) * 2
    return low.split(None, 1)[:1] != [] and low.split(None, 1)[0] in _NAV_FIRST and _NAV_RUN.fullmatch(low) is not None


def _triggers(*patterns: re.Pattern[str]) -> frozenset[str]:
    """Words of four letters or more in the patterns, one of which a line must hold to be worth a search."""
    words = {w for p in patterns for w in re.findall(r"[^\W\d_]{4,}", re.sub(r"\[(.)\ufffd\]", r"\1", p.pattern).replace("\\b", " ")) if w}
    words = {w.lower() for w in words}
    return frozenset(words | {re.sub(r"[^\x00-\x7f]", "\ufffd", w) for w in words})


_TRIGGERS = _triggers(_COOKIE, _LETTER, _LEGAL) | {"cookie", "cookies"}
_STRIP = ".,;:!?–—-()«»„“”\"'"


def kind(s: str) -> str:
    """Kind of one squeezed line, without its neighbours."""
    if not s:
        return "blank"
    n = len(s)
    if n <= 240 and is_nav(s):
        return "nav"
    if n <= 320:
        if s[0] in "©\ufffd(Cc" and _FOOT.search(s) or "–" in s and n <= 160 and _FOOT.search(s):
            return "foot"
        if _HEAD.match(s):
            return "head"
        if _INLINE.match(s):
            return "point"
        if _SHARE.match(s):
            return "share"
        if not _TRIGGERS.isdisjoint([w.strip(_STRIP) for w in s.lower().replace("-", " ").replace("’", " ").split()]):
            if _LETTER.search(s):
                return "letter"
            if _LEGAL.search(s):
                return "legal"
            if _COOKIE.search(s):
                return "cookie"
        if n <= 140 and s[0] in _BY_FIRST and _BYLINE.match(s) and (n <= 60 and not _SENTENCE_END.search(s) or _BYTAIL.search(s)):
            return "byline"
    return ""


_BY_FIRST = frozenset("BPVDАTF")


def ends_sentence(s: str, marks: str = ".!?…;:") -> bool:
    """Is the last character, closing quotes and brackets aside, one of ``marks``?"""
    return s.rstrip("\"'”’»“)]")[-1:] in marks if s else False


def has_digit(s: str) -> bool:
    return any(map(s.__contains__, "0123456789"))


def headline_like(s: str) -> bool:
    """Short, and not a sentence."""
    return 0 < len(s) <= 170 and not _SENTENCE_END.search(s)


_memo: dict[str, str] = {}


def page_lines(content: str | None) -> list[str]:
    """Squeezed lines of a content, garbled text restored; one for each line of the content."""
    if not content:
        return []
    fixed = content if content.isascii() else untangle(content)
    lines = fixed.split("\n")
    if "  " in fixed or "\t" in fixed or "\xa0" in fixed or "\r" in fixed:
        return [" ".join(x.split()) if "  " in x or "\t" in x or "\xa0" in x or "\r" in x else x.strip() for x in lines]
    return [x.strip() for x in lines]


def kinds(lines: list[str]) -> list[str]:
    """Kind of each squeezed line of a page, in order."""
    out: list[str] = []
    pointers = False
    for s in lines:
        if len(s) > 320:
            k = ""
        else:
            k = _memo.get(s)
            if k is None:
                k = kind(s)
                if len(_memo) > 200_000:
                    _memo.clear()
                _memo[s] = k
        if k == "head":
            pointers = True
        elif k == "" and pointers:
            if headline_like(s):
                k = "point"
            else:
                pointers = False
        elif k != "blank":
            pointers = False
        out.append(k)
    return out
