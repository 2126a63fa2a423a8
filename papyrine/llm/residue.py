"""Error pages, notices, filler and unfilled templates in place of content (problem 8).

Method: address slug, title and body are compared, and mismatched, duplicated
low-information responses are flagged with combined host evidence and placeholder
detectors.

Every text is read as lines of sentences, and every sentence as its *skeleton*: the words in small
letters, without numbers and reference codes.  Four kinds of evidence are combined:

* *Duplication*: over all documents, the number of papers and of hosts a skeleton comes with.
* *Mismatch*: it shares no longer word with the titles and address slugs of those papers.
* *Information*: a response is a fixed phrase.  Its words come with it and hardly without it, while
  the words of an ordinary sentence, even of one that is often repeated, stand in many
  others.  This is the *closedness* of a skeleton: the greatest share, over its words, of the
  sentences with that word that have this skeleton.
* *Detectors*: placeholders (unfilled slots, filler Latin, stack traces), wording of notices, and
  plain web words, from the strongest to the weakest.

A placeholder settles a line.  Wording is believed where the line is made of such sentences and does not
match the titles.  Web words need duplication over papers and hosts, a closed phrase and a
mismatch beside them; and a phrase without any word known here needs more of the same, or has to
make up the larger part of the document.  A sentence that stands in paragraphs of other sentences is
no response, however often it is quoted.

One pass reads the texts; what it shuffles is one hash per sentence, combined before the shuffle, and one
count per word.  A second pass reads again only a text for each suspect phrase.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut

#: Different papers that a phrase must come with: of a detected wording, of web words, of unknown words.
PAPERS_WORDING, PAPERS_WEB, PAPERS_UNKNOWN = 2, 4, 8
#: Least closedness of a phrase of web words, and of unknown words.
CLOSED_WEB, CLOSED_UNKNOWN = 0.25, 0.5
#: Share of its papers whose title or slug may share a longer word with a phrase; for wording that a detector knows.
NEAR, NEAR_WORDING = 0.05, 0.5
#: Sentences beside a phrase in its line, on average, more than where it has the fewest: a response stands as it is,
#: while a sentence that is quoted stands in paragraphs of any length.
BESIDE = 2
#: Letters of a word that is compared with titles.
TOLD = 5
#: Counters that a task holds before it hands them over.
FLUSH_WORDS = 400_000

# --- detectors -------------------------------------------------------------------------

_SCRIPT = r"(?:java ?script|scripts?)"
_PAGE = r"(?:page|site|website|app|application|viewer|portal|content|article|document|paper|record|server|service|file)"

_START = [
    # status lines and server errors
    r"(?:http|https|error|code|status|fehler|erreur|código|codigo)(?: (?:code|status))?[ :#-]*[3-5]\d\d\b",
    r"[45]\d\d\s*[-–—:|.]?\s*(?:not found|forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|internal|service|server|too many|page|error|gone|nicht|introuvable|no encontrad)",
    r"(?:an? )?(?:internal|unexpected|fatal|unknown|application|database|runtime) (?:server )?error(?: occurred)?\s*[.!]?$",
    r"(?:bad gateway|gateway time-?out|service unavailable|forbidden|not found|unauthori[sz]ed|page not found|file not found)\s*[.!]?$",
    r"something went wrong",
    r"(?:oops|whoops|uh oh)\b",
    r"(?:query|request|rendering|connection) (?:failed|refused|timed out|reset|blocked)\s*(?:[.!:;,]|$)",
    r"traceback \(most recent call last\)",
    r"file \"[^\"]+\", line \d+",
    r"(?-i:(?:[a-z_]+\.)*[A-Z]\w*(?:Error|Exception))(?::\s|$)",
    r"at [\w$.]+\([\w.]+:\d+\)",
    r"(?:sorry,?\s*)?(?:but )?(?:this|the|that) (?:\w+ ){0,3}" + _PAGE + r" (?:you (?:requested|asked for|are looking for|were looking for) )?(?:(?:does not|doesn't|no longer) exists?\b|(?:could not|cannot|can't) be (?:found|loaded|shown|displayed|opened|reached|rendered|served|accessed)|was not found|is not (?:available|reachable|here\b|accessible|online|found)|is (?:no longer (?:available|here|online)|gone\b)|(?:has been|was|is) (?:(?:re)?moved|deleted|archived|withdrawn|taken down|blocked|unavailable)\s*(?:[.!,;:]|$|for|by|until|from (?:the|this|our)|to a))",
    r"nothing (?:here|was found|to see)\b",
    r"we (?:could not|couldn't|can't|cannot) find (?:the|this|that) " + _PAGE,
    r"(?:try again|please try again|come back) (?:later|soon|in )",
    r"go back to the (?:list|home|start|main|previous)",
    r"check the address instead",
    r"(?:seite|datei|dokument) (?:wurde )?nicht gefunden",
    r"der gesuchte (?:beitrag|artikel)",
    r"(?:la )?page (?:demandée )?(?:introuvable|n'existe|non trouvée)",
    r"página no encontrada",
    r"(?:el|la) (?:artículo|página) (?:pedid|solicitad|buscad)[oa] ",
    r"l'article (?:demandé|recherché) ",
    r"(?:esta|la|el|este) (?:página|artículo|documento|sitio|servicio|contenido) (?:no (?:existe|está|se encuentra|se ha)|ya no|ha sido|está (?:oculto|bloqueado|temporalmente|en|fuera))",
    r"(?:cette|la|le|ce|l') ?(?:page|article|document|site|service|contenu|serveur) (?:n'existe|n'est (?:pas|plus)|est (?:masqué|bloqué|(?:momentanément |temporairement |actuellement )?(?:indisponible|introuvable|inaccessible|en maintenance))|a été|demandée? (?:n'|est))",
    r"(?:diese|die|der|das|dieser|dieses) (?:seite|beitrag|artikel|dokument|dienst|server|inhalt|website) (?:existiert nicht|gibt es nicht|wurde (?:nicht|entfernt|gelöscht|verschoben)|ist (?:ausgeblendet|gesperrt|(?:zurzeit |derzeit |momentan |vorübergehend )?nicht (?:erreichbar|verfügbar|mehr)))",
    r"(?:error interno|erreur interne|interner fehler|error inesperado|erreur inattendue|unerwarteter fehler)\b",
    r"(?:algo salió mal|une erreur (?:est survenue|s'est produite)|ein fehler ist aufgetreten|se ha producido un error|etwas ist schiefgelaufen)",
    r"(?:inténtelo|inténtalo|vuelva a intentarlo|intente) (?:de nuevo|más tarde|nuevamente)",
    r"(?:veuillez )?réessaye[rz] (?:plus tard|dans|ultérieurement)",
    r"(?:bitte )?versuchen sie es (?:später|in|noch|erneut)",
    r"text extraction failed",
    r"no text layer",
    r"the file is (?:encrypted|damaged|corrupt|empty|password)",
    r"(?:could not|unable to|failed to) (?:load|open|read|parse|extract|render|fetch|connect(?: to)?) (?:(?:the|this|that|your) )?(?:requested )?(?:" + _PAGE[3:-1] + r"|pdf|image|resource|module|data|text|abstract|url|host|database|session)\b",
    # maintenance, parked domains
    r"we (?:will|'ll) be (?:right )?back\b",
    r"(?:the|this) (?:proceedings|" + _PAGE[3:-1] + r") (?:are|is) (?:currently |temporarily )?(?:offline|down|unavailable|under maintenance|being updated)",
    r"(?:scheduled|planned) (?:downtime|maintenance)\s*(?:[.!:,]|$|until|from|in progress|on \d|is (?:in progress|under way))",
    r"(?:down|closed) for maintenance",
    r"(?:wartungsarbeiten|wegen wartung)\b",
    r"(?:sitio|servicio|página|servidor) (?:en mantenimiento|no disponible)",
    r"(?:site|service|page|serveur) (?:en maintenance|indisponible|temporairement)",
    r"(?:mantenimiento|maintenance|wartung) (?:programado|programada|prévue|planifiée|en curso|en cours|geplant)",
    r"(?:este dominio|ce (?:nom de )?domaine|diese domain)\b",
    r"this domain (?:name )?(?:is|has|may be) ",
    r"the (?:conference|web) ?site has moved",
    # access, sessions, robots
    r"(?:please )?(?:log|sign) ?in (?:again )?(?:to|with|required|or )",
    r"(?:log|sign)-? ?in (?:is )?required",
    r"login (?:is )?required",
    r"you (?:must|need to|have to) (?:log|sign|be logged|be signed|subscribe|register)",
    r"you (?:have been|were|are) (?:signed|logged) (?:out|off)",
    r"you (?:do not|don't) have (?:permission|access|the rights?)",
    r"(?:your|the|this) session (?:has |is )?(?:ended|expired|timed)",
    r"(?:votre session|votre connexion)\b",
    r"(?:su|tu) sesión (?:ha |está )?(?:expirad|caducad|terminad)",
    r"(?:ihre|deine) (?:sitzung|anmeldung) (?:ist|wurde|hat)",
    r"(?:access|acces)(?: to (?:this|the) [\w ]+)? (?:is |was |has been )?(?:denied|restricted|blocked|forbidden)\s*(?:[.!:]|$|for (?:you|your))",
    r"(?:la|esta) sesión (?:ha |está |se ha )?(?:expirad|caducad|terminad|cerrad)",
    r"(?:la|cette) session (?:a |est )?(?:expiré|terminé|fermé)",
    r"(?:die|diese) (?:sitzung|anmeldung) (?:ist|wurde) (?:abgelaufen|beendet|erforderlich)",
    r"sie (?:wurden|sind) (?:abgemeldet|nicht angemeldet)",
    r"sie (?:müssen|haben) (?:sich (?:erneut )?(?:anmelden|registrieren)|keine? (?:berechtigung|zugriff|rechte))",
    r"(?:vous avez été|vous êtes) (?:déconnecté|redirigé)",
    r"vous (?:devez vous (?:connecter|identifier|inscrire)|n'avez pas (?:accès|l'autorisation|le droit|la permission))",
    r"(?:se ha|ha sido|usted ha) (?:cerrado (?:su|la) sesión|desconectado)",
    r"(?:debe|tiene que|necesita) (?:iniciar sesión|registrarse|identificarse)",
    r"(?:usted )?no tiene (?:permiso|acceso|autorización)",
    r"(?:melden sie sich|bitte melden sie sich|bitte anmelden)\b",
    r"(?:connectez-vous|identifiez-vous|inscrivez-vous)\b",
    r"(?:inicie|inicia) sesión\b",
    r"(?:zu viele anfragen|trop de requêtes|demasiadas (?:solicitudes|peticiones))",
    r"(?:anfrage|requête|solicitud) (?:blockiert|bloquée|bloqueada|gesperrt)",
    r"(?:wir prüfen|nous vérifions|estamos (?:verificando|comprobando))\b",
    r"(?:zugriff|zugang) (?:verweigert|gesperrt)",
    r"acc[eè]s (?:refusé|interdit|limité)",
    r"acceso (?:denegado|restringido|prohibido)",
    r"(?:request|connection|access) blocked",
    r"too many requests",
    r"your (?:address|ip|network|client|browser) (?:has|is|was|sent|blocks)\b",
    r"(?:please )?slow down\s*[.!]?$",
    r"(?:one moment|just a (?:second|moment)|hold on|please wait|un momento|un instant|einen moment)\b[:,. ]*(?:we are|while|please|$)",
    r"(?:we are |we're )?(?:verifying|checking|making sure) (?:that )?(?:your browser|you are (?:a )?human|you are not)",
    r"(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a )?(?:human|not a robot)",
    r"(?:subscribe|register|purchase|buy|pay) (?:now )?to (?:read|continue|see|view|access|unlock)",
    # scripts and loading
    r"(?:please )?(?:turn on|enable|activate|allow|switch on) " + _SCRIPT + r"\b",
    r"you (?:need to|must|have to|should) (?:turn on|enable|activate|allow|switch on) " + _SCRIPT,
    r"(?:this|the|our) " + _PAGE + r" (?:needs|requires|runs on|works only with|depends on|relies on|uses) " + _SCRIPT,
    r"" + _SCRIPT + r" (?:is|are|must be|has to be|have to be|needs to be) (?:switched off|turned off|off|disabled|required|blocked|needed|enabled)",
    r"if nothing appears\b",
    r"(?:your browser|you) (?:blocks|does not support|has disabled)\b",
    r"veuillez (?:autoriser|activer|patienter|accepter)\b",
    r"(?:autorisez|activez) (?:java ?script|les scripts)",
    r"(?:java ?script|les scripts|los scripts|skripte) (?:est|sont|ist|sind|está|están) (?:désactivé|requis|nécessaire|deaktiviert|ausgeschaltet|erforderlich|desactivad|necesari)",
    r"(?:bitte warten|por favor,? espere|un moment)\b",
    r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java ?script|skripte)",
    r"bitte (?:java ?script|skripte)",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita|permita|permite|autorice) (?:el )?(?:uso de )?(?:java ?script|los scripts|scripts)",
    r"(?:diese|die) seite (?:benötigt|braucht|erfordert) (?:java ?script|skripte)",
    r"cette page (?:nécessite|a besoin de|exige) (?:java ?script|scripts)",
    r"esta página (?:necesita|requiere) (?:java ?script|scripts)",
    r"(?:loading|fetching|chargement|cargando|wird geladen)(?: \w+){0,3}\s*(?:…|\.\.\.)",
    r"(?:loading|fetching|chargement|cargando|wird geladen)(?: (?:the|your))?(?: " + _PAGE + r")?\s*[.!]?$",
    # cookies
    r"(?:we|this site|our site|this website) (?:and our partners )?uses? cookies",
    r"(?:accept|reject|allow|refuse|agree)(?: all)?(?: cookies)? ?/ ?(?:accept|reject|decline|manage|refuse|settings|deny|more)\b(?: \w+)?\s*(?:[/.]|$)",
    r"(?:cookie|privacy) (?:settings|preferences|notice|policy|consent)\s*[.!]?$",
    r"this (?:content|page|section|video|text) is (?:hidden|blocked|not shown|unavailable) (?:until|unless|because|in your)",
    r"wir (?:verwenden|nutzen|setzen) cookies",
    r"(?:nous utilisons|ce site utilise) des cookies",
    r"(?:utilizamos|usamos|este sitio usa|este sitio utiliza) cookies",
    r"(?:diese|die) (?:seite|website) (?:verwendet|nutzt) cookies",
    # filler
    r"(?:your|the|insert|add|put|write|type|paste|enter)(?: your| the)? (?:abstract|title|text|summary|content|keywords?|authors?|name)(?: goes| text)? here\b",
    r"(?:this|the) (?:paragraph|section|box|field|area|slot) (?:(?:holds|contains|will hold|will contain|is reserved for) (?:the|your) (?:abstract|title|summary|text|keywords?|authors?|content)\b|is a placeholder)",
    r"(?:sample|dummy|placeholder|filler|example|test) text\s*[,.:;!]",
    r"(?:sample|dummy|placeholder|filler) text$",
    r"(?:click|tap|double-click) (?:here )?to (?:edit|add|insert|replace)",
    r"replace (?:this|the) (?:text|paragraph|line|section)",
    r"author names? (?:will|to) be ",
    r"(?:firstname|first name) (?:lastname|last name)",
    r"\\(?:title|author)\{(?:your|first|title|author|insert)\b",
    r"(?:todo|fixme|tbd|tk)\s*[:!-]\s*\w",
    r"(?:texte|contenu|titre|résumé) à (?:remplacer|compléter|venir|insérer)",
    r"(?:insérez|saisissez|écrivez) (?:ici|votre|le)\b",
    r"(?:escriba|introduzca|inserte|escribe|ponga) (?:aquí|el|su|tu)\b",
    r"hier (?:steht|kommt|folgt|bitte) (?:die|der|das|ihr|ihre|zusammenfassung|text)",
    r"(?:platzhalter|blindtext|mustertext|beispieltext)\b",
    r"(?:hier|ihren|ihre) (?:text|zusammenfassung|titel) (?:einfügen|eingeben|eintragen)",
    r"texto de (?:ejemplo|relleno|muestra)",
    r"(?:content|text|abstract|summary|details?) (?:coming soon|to follow|to be (?:added|announced|completed|written|inserted))",
    # unfilled values
    r"(?:cited|viewed|downloaded|read) (?:by|times) (?:nan|undefined|null|none)\b",
    r"(?:published|posted|updated|presented)(?: (?:on|at|in|by))? (?:undefined|nan|null|none|invalid date)\b",
    r"by (?:none|undefined|null|nan) (?:and|,)",
    r"(?:none|nan|undefined|null) (?:views?|others?|papers?|citations?|authors?|downloads?|results?)\s*[.!,;]?$",
    r"(?:title|authors?|abstract|summary|venue|year|keywords?|paper[ _]url|url|date|topics?|decision|doi|pages?|session|track|poster|titel|autoren|zusammenfassung|titre|auteurs|résumé|título|autores|resumen):\s*(?:undefined|null|none|nan|\[object object\]|invalid date)\s*[.,;]?(?:$|\s+by (?:none|undefined|null|nan))",
    r"\[object object\]",
    r"(\S{2,12})(?:\s+\1){2,}\b(?!\s+(?!(?P<next>\S{2,12})\s+(?P=next)\b)(?-i:[a-zà-ÿ]))",
]
_DETECT = re.compile(r"\s*(?:[#*>•|=-]+\s*)?(?:" + "|".join(p if "\\1" not in p else p.replace("(\\S", "(?P<rep>\\S").replace("\\1", "(?P=rep)") for p in _START) + r")", re.I)
_SOLE = re.compile(r"\s*(?:undefined|nan|null|none|n/a|tbd|lorem ipsum)\s*[.!]?\s*$", re.I)

_SLOT = re.compile(
    r"(?<![\\^_$\w}])(?:\{\{\s*[\w .:|-]{1,40}\s*\}\}|\[\[\s*[\w .-]{1,40}\s*\]\]|<%=?\s*[\w. ]{1,40}\s*%>|[$#]\{\s*[\w.]{1,40}\s*\}"
    r"|\{%\s*\w[^%\n]{0,60}%\}|@@\w{1,40}@@|__[A-Za-z]\w{0,40}?__|<<\s*\w{1,40}\s*>>|%[A-Za-z_]{2,40}%"
    r"|\[\s*(?i:insert|your|enter|add) [^\]\n]{1,60}\]|<\s*(?i:your|insert|enter) [^>\n]{1,60}>|\{[A-Za-z_]{2,40}\}|\{\d{1,2}\})"
)
_LABEL = re.compile(r"\s*(?:[#*>•-]+\s*)?(?:[\w ]{1,24}[:=]\s*)?[.,;]?\s*$")

_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit "
    "esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit cras minor et".split()
)
_ANCHOR = frozenset("lorem ipsum dolor amet consectetur adipiscing nulla velit".split())
_FUNCTION = frozenset(
    "the of and to is that with for our we are by on as it this der die das und ist nicht mit ein eine auf den le la les des est une "
    "dans pour que qui el los las del una por con es se".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def _unfilled(line: str) -> bool:
    """Slots make up the line: nothing but a label is left, or few words around two slots."""
    if not ("{" in line or "[" in line or "<" in line or "%" in line or "@@" in line or "__" in line):
        return False
    found = _SLOT.findall(line)
    if not found:
        return False
    rest = _SLOT.sub(" ", line)
    if _LABEL.match(rest):
        return True
    return len(found) >= 2 and '"' not in rest and "“" not in rest and len(_WORD.findall(rest)) <= 2 * len(found) + 2


def _latin(line: str) -> bool:
    """Filler Latin: several of its words, and hardly any function word of a language."""
    low = line.lower()
    if not any(w in low for w in _ANCHOR):
        return False
    words = [w.lower() for w in _WORD.findall(line)]
    known = sum(w in _LATIN for w in words)
    return (
        len(words) >= 4
        and sum(w in _ANCHOR for w in words) >= 2
        and known >= 0.2 * len(words)
        and sum(w in _FUNCTION for w in words) <= 0.06 * len(words)
    )


def placeholder(line: str) -> bool:
    """Whether a line is an unfilled template or filler Latin."""
    return _unfilled(line) or _latin(line)


def detected(sentence: str) -> bool:
    """Whether a sentence has the wording of a notice or is a value left out."""
    return bool(_DETECT.match(sentence) or _SOLE.match(sentence) or _unfilled(sentence))


def is_residue(line: str) -> bool:
    """Whether the detectors alone, without the evidence of other documents, take a line for a response."""
    if placeholder(line):
        return True
    found = [detected(s) for s in _SENTENCE.split(line) if not _neutral(s)]
    return 2 * sum(found) >= len(found) > 0 and any(found)


# --- sentences ---------------------------------------------------------------------------

# Words of web pages and forms, in the four languages of the corpus (fixed values).
_WEB = frozenset(
    "page pages site website browser login signin session account password cookies cookie javascript script scripts loading download "
    "link url unavailable offline maintenance subscribe captcha verify redirect timeout here service moved expired blocked denied "
    "navigateur connexion compte chargement lien indisponible ici session expiré bloqué serveur momentanément déconnecté "
    "seite anmelden abgemeldet konto laden gesperrt wartung hier sitzung abgelaufen dienst erreichbar anfrage "
    "sitio navegador sesión cuenta cargando enlace página mantenimiento aquí servicio caducado caducada expirado bloqueado".split()
)
# Of these, words that settle a line of up to four words alone (fixed values).
_WEB_SURE = frozenset("login signin captcha javascript cookies abgemeldet anmelden sitzung sesión caducado indisponible déconnecté wartung mantenimiento".split())
#: Web words that a phrase must have.
WEB_WORDS = 2
# Words of notes on rights, thanks and sources that are repeated under texts (fixed values).
_FURNITURE = frozenset(
    "license licensed licence licensing copyright rights reserved creative commons doi isbn issn arxiv thank thanks acknowledge acknowledgements funded supported grant "
    "published proceedings reprinted preprint lizenz rechte vorbehalten urheberrecht dank gefördert licencia derechos reservados gracias licence droits réservés remercions".split()
)
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"\b(?=\w*\d)\w+\b")
_MENU = re.compile(r"\S *[|›»] *\S|^\s*(?:back to top|previous|next|home|contents|menu)\b", re.I)
_END = re.compile(r"[.!?…:。][\"'”’»)\]]*\s*$")


def skeleton(sentence: str) -> list[str]:
    """The words without numbers and codes, in small letters."""
    low = sentence.lower()
    return _WORD.findall(_CODE.sub(" ", low) if _DIGIT.search(low) else low)


def _neutral(sentence: str) -> bool:
    """A reference code or number, alone or after a word or two: 'Trace d51095803e'."""
    words = skeleton(sentence)
    return not words or (len(words) <= 2 and _CODE.search(sentence) is not None and not _DETECT.match(sentence))


def _hash(words: list[str]) -> int:
    n = xxhash.xxh64_intdigest(" ".join(words))
    return n - (1 << 64) if n >= 1 << 63 else n


WORDING, PLACEHOLDER = 1, 2
_SENTENCES = "array<struct<hash:long,line:int,n:int,words:int,kind:int,ends:boolean>>"


def _sentences(text: str) -> list[tuple[int, int, int, list[str], int, bool]]:
    """(hash, line, sentences of the line, words, kind, whether the line ends as a sentence) of every sentence."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out = []
    for at, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            continue
        if placeholder(line):
            words = skeleton(line)
            out.append((_hash(words), at, 1, words, PLACEHOLDER, True))
            continue
        held = []
        for s in _SENTENCE.split(line):
            words = skeleton(s)
            sure = detected(s)
            if sure or (words and not (len(words) <= 2 and _CODE.search(s))):
                held.append((words, WORDING if sure else 0))
        ends = _END.search(line) is not None and not _MENU.search(line)
        out += [(_hash(words), at, len(held), words, kind, ends) for words, kind in held]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, paper, host, start, doc_words, sentences, word, n): a row for each text, then rows of word counts."""
    counts: Counter[str] = Counter()
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["hash", "line", "n", "words", "kind", "ends"]
    columns = ["doc", "paper", "host", "start", "doc_words", "sentences", "word", "n"]
    first = None

    def flush() -> pa.RecordBatch:
        n = len(counts)
        none = [pa.nulls(n, t) for t in first.types[:6]]
        out = pa.RecordBatch.from_arrays([*none, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=columns)
        counts.clear()
        return out

    for batch in batches:
        offsets, flat, starts, sizes = [0], [], [], []
        for text in batch.column(3).to_pylist():
            found = _sentences(text)
            for row in found:
                counts.update(set(row[3]))
            flat += [(h, at, n, len(w), kind, ends) for h, at, n, w, kind, ends in found]
            offsets.append(len(flat))
            starts.append(_hash(text.lstrip()[:1000].split("\n", 1)[:1]))
            sizes.append(sum(len(row[3]) for row in found))
        inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 6, kinds)], names=names)
        n = batch.num_rows
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
            names=columns,
        )
        first = out.schema if first is None else first
        yield out
        if len(counts) >= FLUSH_WORDS:
            yield flush()
    if counts:
        yield flush()


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, words) of the sentences of texts."""
    for batch in batches:
        found = {row[0]: row[3] for text in batch.column(0).to_pylist() for row in _sentences(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.string()))], names=["hash", "words"])


def residue_documents(
    documents: DataFrame,
    papers: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str | None = "source",
    paper: str | None = "event_id",
    title: str = "title",
    slug: str | None = "virtual_url",
    same_papers: int = PAPERS_WEB,
) -> DataFrame:
    """(doc_id, evidence): documents holding residue.

    evidence is 'duplicated' where the phrase comes with several papers on several hosts, else
    'placeholder' or 'wording', the detector that speaks alone.

    * Rows with a null identifier or text take no part; an empty text holds no residue.
    * Every copy of a document is judged by its own text, so copies come out alike.
    * A document without a paper counts as a paper of its own by its first line, so its copies are one.
    * Without ``papers`` nothing is compared with titles.  Empty tables give no rows; other columns are
      ignored.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    about = documents.select(
        F.col(doc_id).alias("doc"),
        (F.col(paper) if paper else F.lit(None).cast("long")).alias("paper"),
        (F.lower(F.trim(host)) if host else F.lit(None).cast("string")).alias("host"),
        F.col(text).alias("text"),
    ).where("doc is not null and text is not null")
    paper_kind = about.schema["paper"].dataType.simpleString()
    scanned = cut(about.mapInArrow(_scan, f"doc {kind}, paper {paper_kind}, host string, start long, doc_words int, sentences {_SENTENCES}, word string, n long"))
    texts = scanned.where("word is null")
    unit = F.when(F.col("paper").isNull(), F.xxhash64(F.lit("start"), "start")).otherwise(F.xxhash64(F.lit("paper"), "paper"))
    rows = texts.select("doc", "paper", F.xxhash64("host").alias("host"), unit.alias("unit"), "doc_words", F.inline("sentences")).withColumnRenamed("n", "of")

    # host evidence: papers and hosts of every phrase
    once = rows.groupBy("hash", "unit").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.min("of").alias("least"), F.sum("of").alias("sum"), F.min("host").alias("h1"), F.max("host").alias("h2"), F.min("doc").alias("doc"))
    seen = once.groupBy("hash").agg(F.count("*").alias("papers"), F.sum("n").alias("n"), F.max("kind").alias("kind"), (F.sum("sum") <= (F.min("least") + BESIDE) * F.sum("n")).alias("stands"), (F.min("h1") < F.max("h2")).alias("hosts"), F.min("doc").alias("doc"))
    suspects = cut(seen.where((F.col("kind") > 0) | ((F.col("papers") >= same_papers) & (F.col("hosts") | (F.col("papers") >= 2 * same_papers)) & F.col("stands"))))

    # their words, read again from one text each
    again = about.select("doc", "text").join(suspects.select("doc").distinct(), "doc", "left_semi").select("text").mapInArrow(_phrases, "hash long, words array<string>")
    phrases = again.join(suspects.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.first("words").alias("words"))
    each = phrases.join(suspects.select("hash", "n"), "hash").select("hash", "n", F.explode(F.array_distinct("words")).alias("word"))
    known = scanned.where("word is not null").groupBy("word").agg(F.sum("n").alias("total"))
    closed = each.join(known, "word").groupBy("hash").agg(F.max(F.col("n") / F.col("total")).alias("closed"))
    web = F.size(F.filter("words", lambda w: w.isin(*_WEB)))
    sure = (F.size("words") <= 4) & F.exists("words", lambda w: w.isin(*_WEB_SURE))
    furniture = F.exists("words", lambda w: w.isin(*_FURNITURE))
    judged = suspects.drop("doc").join(phrases, "hash").join(closed, "hash", "left").select(
        "hash", "kind", "papers", "hosts", F.coalesce("closed", F.lit(0.0)).alias("closed"), ((web >= WEB_WORDS) | sure).alias("web"), furniture.alias("furniture"),
        F.filter("words", lambda w: F.length(w) >= TOLD).alias("told"),
    )
    judged = cut(judged.where((F.col("kind") > 0) | ((F.col("closed") >= CLOSED_UNKNOWN) & ~F.col("furniture")) | (F.col("web") & (F.col("closed") >= CLOSED_WEB))))

    # titles and slugs of the papers they come with
    if papers is not None and paper:
        names = papers.select(
            F.col(paper).alias("paper"),
            F.array_distinct(F.split(F.lower(F.concat_ws(" ", F.col(title), F.regexp_replace(F.col(slug), r"[^A-Za-z]+", " ") if slug else F.lit(""))), r"[^\p{L}]+")).alias("terms"),
        ).where("paper is not null").groupBy("paper").agg(F.max("terms").alias("terms"))  # of several deliveries one, always the same
        met = rows.where("paper is not null").select("hash", "paper").join(judged.select("hash", "told"), "hash").distinct()
        near = met.join(names, "paper").groupBy("hash").agg(F.avg(F.arrays_overlap("told", "terms").cast("double")).alias("near"))
        judged = judged.join(near, "hash", "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    else:
        judged = judged.withColumn("near", F.lit(0.0))
    many = F.col("hosts") | (F.col("papers") >= 2 * same_papers)
    judged = judged.select(
        "hash",
        ((F.col("papers") >= PAPERS_WORDING) & F.col("hosts")).alias("repeated"),
        F.when(F.col("kind") == PLACEHOLDER, "placeholder")
        .when((F.col("kind") == WORDING) & (F.col("near") <= NEAR_WORDING), "wording")
        .when((F.col("near") <= NEAR) & (F.col("papers") >= same_papers) & many & F.col("web"), "web")
        .when((F.col("near") <= NEAR) & (F.col("papers") >= PAPERS_UNKNOWN) & F.col("hosts") & (F.col("closed") >= CLOSED_UNKNOWN) & ~F.col("furniture"), "unknown")
        .alias("why"),
    ).where("why is not null")

    # a line is a response if such sentences make it up
    met = rows.join(judged, "hash")
    of = lambda *why: F.count(F.when(F.col("why").isin(*why), 1))
    lines = met.groupBy("doc", "doc_words", "line", "of", "ends").agg(
        of("placeholder").alias("placeholders"), of("wording").alias("wording"), F.count("*").alias("found"), of("unknown").alias("unknown"), F.max("repeated").alias("repeated"), F.sum("words").alias("words"),
    )
    whole = F.col("found") >= F.col("of")
    lines = lines.withColumn(
        "is",
        F.when(F.col("placeholders") > 0, "placeholder")
        .when((F.col("wording") > 0) & (2 * F.col("found") >= F.col("of")), "wording")
        .when(whole & ((F.col("unknown") == 0) | F.col("ends")), "duplicated")
        .when(whole, "part"),
    ).where(F.col("is").isNotNull())
    docs = lines.groupBy("doc").agg(
        F.max(F.col("is") != "part").alias("sure"), F.max((F.col("is") == "duplicated") | (F.col("repeated") & (F.col("is") != "part"))).alias("duplicated"),
        F.max(F.col("is") == "placeholder").alias("placeholder"), (2 * F.sum("words") >= F.first("doc_words")).alias("most"),
    ).where("sure or most")
    evidence = F.when(F.col("duplicated") | ~F.col("sure"), "duplicated").when(F.col("placeholder"), "placeholder").otherwise("wording")
    return docs.select(F.col("doc").alias(doc_id), evidence.alias("evidence"))
