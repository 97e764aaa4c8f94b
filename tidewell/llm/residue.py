"""Template residue, filler, error pages and script notices in documents.

Method: labelled exemplars of residue are kept in an inverted index.  Words are
first reduced to terms by a small thesaurus (spelling, inflection and language
fall together: "enable", "allow", "aktivieren" are one term), so an exemplar
stands for all its wordings.  A passage (a markdown or raw cell) retrieves the
exemplars of whose distinct terms it holds RETRIEVE; windows over the passage
are then scored by TF-IDF containment, with document frequencies counted over
all passages of the corpus.  A document is excluded when a window contains an
exemplar to a high degree and residue makes up the lines it stands in, so prose
that mentions the same words stays.

Filler is the other way round: a paragraph contained in an exemplar's
vocabulary.  A paragraph without any function word needs a smaller share of it,
since no text in a natural language does without them.

Unfilled placeholders are exemplars of one term each: the shape of the
placeholder.  They count anywhere in a passage except in code spans, code
fences, quotations and formulas.

Beside the exemplars runs one rule, on every passage: a line that is one unit
of at most three words four times or more is filler.

Defined results: a null or empty text, and a document without cells, is no
case; each document appears once; cells of other types never count; very long
cells are processed whole, and no pattern has a greatest length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.cells import cell_lists, steps
from tidewell.session import small_batches, staged

#: Share of an exemplar's distinct terms that a passage, and later a window, must hold.
RETRIEVE = 0.75
#: Least TF-IDF containment of an exemplar in a window.
CONTAINED = 0.8
#: Least share of residue among the content words of the lines that a match stands in.
LINE_SHARE = {"message": 0.6, "prompt": 0.8, "filler": 0.75}
#: Least words of a filler paragraph, distinct filler terms in it, and its least containment.
FILLER_WORDS = 4
FILLER_TERMS = 3
#: The same for a paragraph without function words.
FILLER_BARE = 0.25

#: Terms of messages and the words that mean them, "|" before forms of several words.
THESAURUS = """
javascript: javascript js ecmascript noscript
scripts: script scripts scripting skript skripte skripten
cookies: cookie cookies
enable: enable enabled enabling allow allowed activate activated active permit aktivieren schalten aktiviert aktivierte eingeschaltet einschalten zulassen erlauben erlaubt zugelassen activer activez active autoriser autorisez permitir permita permitidos permitido habilitar habilite habilitado activar abilita abilitare ative habilitados | turn on, turn it on, turned on, switch on, switched on
off: disabled off deactivated deaktiviert ausgeschaltet abgeschaltet desactive desactivado desactivada deshabilitado inhabilitado | turned off, switched off, not enabled, not active, nicht aktiviert, pas active, no esta activado
need: need needs needed require requires required requiring must necessary relies mandatory depends benotigt benotigen erfordert erforderlich braucht muss voraussetzung necessite necessaire requiert requis doit necesita requiere requerido necesario debe richiede
without: without ohne sans sin
work: work works working running runs lauft functionality properly correctly correctement correctamente richtig funktioniert fonctionne funciona funktionieren fonctionner funcionar
browser: browser browsers web settings einstellungen parametres configuracion ajustes navigateur navegador
page: page pages site website webpage viewer view app application notebook document file resource content url address link seite webseite website ansicht dokument datei inhalt vue carnet fichier contenu ressource adresse pagina sitio vista visor cuaderno archivo recurso contenido direccion aplicacion anwendung webseiten directory folder article artikel item notizbuch dashboard
service: service dienst servicio services
show: display displayed show shown see read reading keep viewing watch browse lesen lire leer continue proceed run load loads loaded loading render rendering converting conversion respond responding response open visit reach use using start utiliser utilisez usar utilizar nutzen benutzen verwenden anzeigen angezeigt anzuzeigen sehen fortfahren laden geladen afficher voir continuer charger chargement ver mostrar continuar cargar visualizar execution
notfound: notfound introuvable unauffindbar inexistente inexistant | not found, could not be found, couldn t be found, cannot be found, can t be found, can not be found, couldn t find, could not find, can t find, cannot find, cant find, can t seem to find, unable to find, was not found, wasn t found, doesn t exist, does not exist, do not exist, no longer exists, not exist, nicht gefunden, nicht finden, existiert nicht, gibt es nicht, no encontrada, no encontrado, no se encontro, no se ha encontrado, no se pudo encontrar, no existe, ya no existe, n existe pas, n existe plus, pas ete trouvee, pas ete trouve, non trouvee, non trouve, non trovata, nao encontrada dies dein deine deinen du
nothing: nothing nichts rien nada
moved: moved removed deleted renamed gone archived private withdrawn verschoben geloscht entfernt umbenannt privat deplace deplacee supprime supprimee prive movido movida eliminado eliminada borrado borrada privado
notcode: 404 410
authcode: 401 403 407
busycode: 429
timecode: 408 504 522 524
failcode: 500 501 502 503 505 520 521 523
badcode: 400 405 406 409 413 414 415 418 422
error: error errors fehler serverfehler erreur erreurs err errore erro fault exception misconfiguration
http: http https port html ssl plain status statuscode
internal: internal interner interne interno interna internes
gateway: gateway
support: support supports supported unterstutzt unterstutzung supporte soporta compatible
turn: turn turned
server: server servidor serveur servers host hosts proxy upstream backend database renderer client console
bad: bad ungultige ungultig mauvaise incorrecta invalid malformed
request: request requests requested looking searching gesuchte suchen recherchez recherchee cherchez busca buscas send sent received angeforderte angeforderten demandee solicitada solicitado method methode metodo operation anfrage anfragen requete requetes demande solicitud solicitudes peticion peticiones
toomany: | too many, zu viele, trop de, demasiadas, demasiados, rate limit, rate limited, limit exceeded, quota exceeded
exceeded: exceeded depasse uberschritten excedido
toolong: | too long, zu lange, trop de temps, demasiado tiempo
timeout: timeout timedout zeituberschreitung | timed out, time out, delai depasse, delai d attente, tiempo agotado, tiempo de espera
took: took taking gedauert pris tardo
forbidden: forbidden unauthorized unauthorised interdit verboten prohibido verweigert | not authorized, not authorised, access denied, permission denied, access is denied, zugriff verweigert, zugang verweigert, keine berechtigung, keinen zugriff, keinen zugang, need permission, need access,  acces refuse, acces interdit, acceso denegado, acceso restringido, not allowed, not permitted, no permission, sufficient permissions, insufficient permissions, sufficient permission, required permissions, do not have permission, don t have permission, do not have access, don t have access, n avez pas acces, no tiene permiso, no tiene acceso, pas autorise, nicht berechtigt
session: session sessions sitzung sesion token
expired: expired inactivity abgelaufen expire expiree caducado caducada expirado expirada inactividad inactivite inaktivitat ended closed | logged out, signed out
signin: login anmelden einloggen connecter reconnectez reconnecter connectez conectarse | sign in, signed in, log in, logged in, log back in, inicie sesion, iniciar sesion, iniciar la sesion, identifiez vous, melden sie sich
unavailable: unavailable unreachable offline down outage indisponible inaccessible inaccesible nichtverfugbar | not available, isn t available, aren t available, is not available, not reachable, nicht erreichbar, nicht verfugbar, nicht mehr verfugbar, nicht mehr erreichbar, no longer available, no longer accessible, plus disponible, ya no esta disponible, no longer valid,  no disponible, no esta disponible, pas disponible, not responding, did not respond, didn t respond, did not answer, not respond, antwortet nicht, no responde, ne repond pas, can t be reached, cannot be reached
denied: denied rejected refused verweigert abgelehnt refusee rechazado rechazada denegado
maintenance: maintenance downtime capacity wartung wartungsarbeiten mantenimiento
temporarily: temporarily temporary currently vorubergehend derzeit temporairement actuellement temporalmente momentaneamente momentan momentanement zurzeit moment stand
wrong: wrong schiefgelaufen schiefgegangen fehlgeschlagen | went wrong, mal passe, mal tourne, salio mal, ido mal, ist schief gelaufen, ist schief gegangen, has failed
something: something etwas quelque chose algo oops whoops uh
failed: failed fails unable problem problems probleme problemas crashed failure crash aborted broken broke breaks defekt
occurred: occurred aufgetreten survenue survenu ocurrido ocurrio produjo producido produite produit encountered
unexpected: unexpected unerwarteter inattendue inesperado
loaderror: | error loading, failed to load, failed to fetch, error while loading, error fetching, could not load, couldn t load, unable to load, erreur de chargement, fehler beim laden, error al cargar
attempts: attempts attempt versuche tentatives intentos logins
connection: connection connect connecting connected verbindung connexion conexion network
refused: reset disconnect disconnected lost interrupted abgelehnt unterbrochen interrompue perdida establishing establish
retry: retry retrying reload refresh try again later wait versuchen versuche erneut spater neuladen aktualisieren reessayez reessayer recharger rechargez intentelo intentar vuelva nuevo reintentar recargue recargar reconnect | noch einmal, plus tard, mas tarde, de nuevo
soon: time zeit temps tiempo now scheduled seconds minutes minute minuten sekunden secondes minutos segundos moments shortly back soon slow slowdown
contact: contact administrator admin webmaster help kontaktieren administrateur administrador team
sorry: sorry apologies apologize hmm oops entschuldigung desole lo siento leider unfortunately lamentablemente malheureusement inconvenience
access: access permissions permission privileges zugriff zugang acces acceso berechtigung
verify: verify prove proof verifying checking check confirm uberprufen uberpruft verifier verificando comprobando security secure sicherheit securite seguridad
human: human humans robots robot bot captcha mensch humain humano cloudflare ddos
blocker: blocker blockers adblock adblocker adblockers extension extensions pause noscripts
blocked: blocked suspended locked gesperrt bloque bloqueado banned
account: account accounts switch credentials konto compte cuenta user
reference: ref reference id incident ray ticket trace
side: side end part planned until
"""

#: The same for prompts and filler.
PROMPT_THESAURUS = """
answered: answer answers antwort reponse respuesta solution losung solucion explanation begrundung explication explicacion response
yours: your yours ihr ihre ihren dein deine deinen votre vos ta ton tu tus su sus seu sua
text: text texts texto texte paragraph paragraphs absatz paragraphe parrafo words word wording comment comments kommentar sentence
heading: heading headline header title subtitle uberschrift titel titre intitule entete encabezado titulo
summary: description summary abstract introduction intro overview beschreibung zusammenfassung resume resumen descripcion caption bio details notes conclusion conclusions
code: code codigo codes solution
name: name names namen nom nombre date author
here: here hier ici aqui below above unten dessous abajo underneath
write: write tapez tippen teclee type enter put insert add fill provide place paste replace delete remove erase edit change schreiben schreiben sie eintragen eingeben einfugen tragen ersetzen loschen bearbeiten ecrivez ecrire inserer inserez entrez saisissez saisir remplacez remplacer effacez supprimez ajoutez ajouter escriba escribe escribir ingrese introduzca insertar inserte reemplace reemplazar sustituya borre anada agregue complete replacing deleting doubleclick rellene schreibe gib fugen einfugt eintrag notieren tippe ponga pon escribelo mettez notez ingresa ingresar digite bitte | double click, fill in, fill out, gehort hierher
goes: goes belongs comes steht kommt gehort stehen va vont vienen
own: own eigene eigenen propre propias propios eigener
line: line hint cell section field box instruction instructions template block zeile hinweis zelle feld abschnitt ligne consigne cellule champ linea indicacion celda campo seccion prompt bracketed kurze kurzen breve courte court corta corto box short brief quick one markdown example
fillertext: blindtext platzhaltertext fulltext
filler: filler placeholder dummy sample platzhalter relleno remplissage factice mock lipsum
todo: todo tbd fixme
"""

#: Words that carry no content, in the languages of the thesaurus; neutral in a line.
FUNCTION_WORDS = """
a an the of to in on for and or is are was were be been being by with at from as it its this that these those there you we our us i me my they them their he she his her
have has had do does did can could will would may might should shall not no nor any some all both more than so just yet still already please before after then while about into out up over under re t ll ve m d doesn don isn aren couldn didn won wasn weren hasn haven cannot due very full either looks like seems appears only both
der die das den dem des ein eine einen einem einer ist sind war wird werden wurde kann konnen sie ihnen wir unser uns es er und oder nicht kein keine bitte um zu zur zum im in am an auf fur mit von bei aus nach dieses diese diesen dieser dass als auch noch nur mehr wurden konnte konnten mussen muss habe haben hat hatte gemacht da
le la les l un une de du des d et ou ce cet cette ces vous nous notre il elle est sont a ete etre pas ne n plus pour par dans sur avec au aux en y qui que s il veuillez se
el los las lo una unos de del al y o este esta esto estos usted se es son ha han sido ser esta estan no ni por favor para con en que a ya mas le nos otra vez tiene tienes
il lo gli uno di da per con si non e o um uma os as do da no na em
"""

#: Labelled exemplars: error pages and notices that something is required.
MESSAGES = """
enable JavaScript
JavaScript is disabled
JavaScript not supported by the browser
turn JavaScript on
browser not running JavaScript
allow scripts
JavaScript is required
does not work without JavaScript
this page requires scripts
scripts must be enabled in the browser
scripts disabled in the browser
enable cookies
cookies required
page not found
not found
failed to find page
404 page
404 error
404 not found
404 notfound http
410 page moved
there is nothing on this page
page has been removed
page was moved or is no longer available
400 bad request
bad request error
401 unauthorized
403 forbidden
403 error
405 error
408 timeout
access denied to this page
forbidden
access has been denied
no permission to access page
access denied on this server
429 too many requests
too many requests
rate limit exceeded, try again
too many attempts
500 internal error
internal error
502 error
500 error http
internal server error
server error exception occurred
error establishing connection
502 bad gateway
503 service unavailable
504 gateway timeout
gateway timeout
request timeout
timeout exceeded
bad gateway
service unavailable
page unavailable
temporarily unavailable
server unavailable
site unavailable
server failed to complete request
request failed with error
request failed with status 404
request failed with status 500
connection error
unable to connect to server
page took too long to load
connection timed out
connection refused
connection reset
connection reset error
connection lost error
session expired
session timeout
sign in to continue
sign in to access page
signed in to see page
sign in again
signed out for inactivity
sign in required
sign in to view
something went wrong
something broke, try again
something failed
an error occurred try again
unexpected error occurred
failed to load page
page failed try again
try again later error
maintenance temporarily
down for maintenance
site maintenance
verify human
verify you are not a robot
verify no robot
checking browser
checking site connection
security check to access page
blocked request
sorry blocked
page blocked
account blocked
"""

#: Labelled exemplars: prompts that were to be replaced.
PROMPTS = """
type your answer here
type here
enter here
your answer here
your text here
your heading here
your description here
your code here
your name here
write your description here
title goes here
answer goes here
summary goes here
insert heading
insert text
insert description
add a description of this page
add heading
add your comments
add text here
write here
write your name
replace this text
replace this line
replace me with your own text
write your own text
delete this line and write
write your answer
write your code
fill in this section
edit this cell
"""

#: Labelled exemplars: filler by name.
NAMED_FILLERS = """
blindtext
filler text
filler heading
filler page
"""

#: Labelled exemplars: filler, as the words it is made of.
FILLERS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas mauris pharetra vitae lacus augue quam felis varius dictum mollis porta eros tempus nunc sagittis ornare fermentum donec aenean phasellus vivamus curabitur praesent suspendisse blandit tortor tellus risus massa sapien ligula justo perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit nam libero tempore cum soluta nobis eligendi optio cumque nihil impedit quo minus quod maxime placeat facere possimus assumenda at vero eos accusamus iusto dignissimos ducimus odio metus urna lectus purus viverra placerat
foo bar baz qux
asdf asdfg qwerty
blah bla
"""

#: Parts of the names that stand in placeholders of weak shape ({x}, <X>, [X], [[x]], __X__).
NAME_PARTS = """
title subtitle goal date author name first last middle full user customer client company employee student teacher instructor school university organization organisation department course class project dataset data contact summary description subject topic email phone address street city country team event product job position month year day place location recipient sender greeting signature your my our the insert here heading text
titel datum kurs ziel kontakt kurzfassung beschreibung datensatz projekt projektname autor vorname nachname firma thema ort
titulo fecha curso objetivo contacto resumen descripcion nombre apellido empresa proyecto asignatura del de
titre cours objectif resume nom prenom projet du entreprise sujet
"""

_fold = {ord(c): unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1} | {ord("ß"): "ss", ord("œ"): "oe", ord("æ"): "ae"}
_token = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    """Lower-case words without accents."""
    text = text.lower()
    return _token.findall(text if text.isascii() else text.translate(_fold))


_part = "(?:" + "|".join(sorted(set(terms_of(NAME_PARTS)), key=len, reverse=True)) + ")"
#: A name made of name parts only.
_name = _part + r"(?:[ _.-]*+" + _part + r")*\d*"
_word = r"[^\W\d][\w. -]*+"
#: Strong shapes take any name; weak ones need a name made of NAME_PARTS.  Patterns end at a bracket or line, not at a length.
PLACEHOLDERS = {
    "mustache": re.compile(r"(?<!\{)\{\{\s*" + _word + r"\s*\}\}(?!\})"),
    "dollar": re.compile(r"\$\{\s*" + _word + r"\s*\}"),
    "hash": re.compile(r"#\{\s*" + _word + r"\s*\}"),
    "erb": re.compile(r"<%=?\s*" + _word + r"\s*%>"),
    "percent": re.compile(r"%%[^\W\d]\w*%%"),
    "at": re.compile(r"@@[^\W\d]\w*@@"),
    "insert": re.compile(r"\[\s*(?:insert|your|enter|add|type|insertar|inserte|inserer|inserez|votre|ihr|ihre|su)\s[^\[\]\n]+\](?!\()|\[[^\[\]\n]+\s(?:here|hier einfugen|einfugen|eintragen|aqui|ici)\s*\](?!\()"),
    "double": re.compile(r"\[\[\s*" + _name + r"\s*\]\]"),
    "dunder": re.compile(r"(?<!\w)__" + _name + r"__(?!\w)"),
    "brace": re.compile(r"(?<![\w{$#\\}^/])\{\s*" + _name + r"\s*\}(?![}/])"),
}
#: Shapes whose names are in capitals.
CAPITALS = {
    "angle": re.compile(r"<" + _name.replace(_part, _part.upper()) + r">"),
    "bracket": re.compile(r"(?<!\[)\[" + _name.replace(_part, _part.upper()) + r"\](?![\](\[:])"),
    "title case": re.compile(r"(?<!\[)\[" + _part.title() + r"(?:[ _-]" + _part.title() + r")+\](?![\](\[:])"),
}
_any_shape = re.compile(r"[{\[<]|%%|@@|__")
_quoted = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|``.*?``|`[^`\n]*`|\$\$.*?\$\$|(?<!\$)\$(?![{$\s])[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]|\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]|<(?:code|pre)\b.*?</(?:code|pre)>", re.S | re.I)
_head = re.compile(r"<(title|style|script)\b[^>]*>.*?</\1>", re.S | re.I)
_block_tag = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|tr|td|th|table|body|html|head|section|article|header|footer|nav|main|center|noscript|blockquote|form)\b[^<>]*>", re.I)
_tag = re.compile(r"</?[A-Za-z!][^<>]*>")


class Terms:
    """The thesaurus: from words to terms."""

    def __init__(self, thesaurus: str = THESAURUS + PROMPT_THESAURUS):
        self.single: dict[str, str] = {}
        many: dict[tuple[str, ...], str] = {}
        for line in thesaurus.strip().split("\n"):
            term, _, forms = line.partition(":")
            words, _, phrases = forms.partition("|")
            for w in terms_of(words):
                self.single.setdefault(w, term)
            for p in phrases.split(","):
                if p.strip():
                    many[tuple(terms_of(p))] = term
        self.neutral = set(terms_of(FUNCTION_WORDS))
        #: Phrases by their first word, longest first.
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for p, term in sorted(many.items(), key=lambda x: -len(x[0])):
            self.phrases.setdefault(p[0], []).append((p, term))
        #: Phrases by their least common word, as sets: what a passage may hold.
        self.possible: dict[str, list[tuple[frozenset[str], str]]] = {}
        for p, term in many.items():
            content = [w for w in p if w not in self.neutral] or list(p)
            self.possible.setdefault(content[0], []).append((frozenset(p), term))
        self.words = set(self.single) | set(self.possible)

    def reduce(self, words: list[str]) -> list[str | None]:
        """Per word its term; None for neutral ones and for the rest of a phrase, the word itself if unknown."""
        out: list[str | None] = []
        i = 0
        while i < len(words):
            w = words[i]
            for p, term in self.phrases.get(w, ()):
                if tuple(words[i : i + len(p)]) == p:
                    out += [term] + [None] * (len(p) - 1)
                    i += len(p)
                    break
            else:
                term = self.single.get(w)
                out.append(term if term else None if w in self.neutral else w)
                i += 1
        return out

    def of(self, distinct: set[str]) -> set[str]:
        """The terms that a passage of these words may hold."""
        found = set()
        for w in self.words & distinct:
            if w in self.single:
                found.add(self.single[w])
            for p, term in self.possible.get(w, ()):
                if p <= distinct:
                    found.add(term)
        return found


class Exemplars:
    """The labelled exemplars and their inverted index."""

    def __init__(self, messages: str = MESSAGES, prompts: str = PROMPTS, named: str = NAMED_FILLERS, fillers: str = FILLERS, messages_of: str = THESAURUS, prompts_of: str = PROMPT_THESAURUS):
        self.terms = Terms(messages_of + prompts_of)
        lines = lambda s: [x for x in s.strip().split("\n") if x.strip()]
        bags = {frozenset(t for t in self.terms.reduce(terms_of(x)) if t): k for k, s in (("message", messages), ("prompt", prompts), ("filler", named)) for x in lines(s)}
        self.bags = [b for b in bags if b]
        self.kinds = [bags[b] for b in self.bags]
        self.fillers = [set(terms_of(x)) for x in lines(fillers)]
        self.short = {tuple(terms_of(x)) for x in ("lorem ipsum", "foo bar", "foo bar baz", *lines(named))}
        # a prompt is short: it has all its terms
        self.needed = [int(np.ceil((RETRIEVE if k == "message" else 1) * len(b))) for b, k in zip(self.bags, self.kinds, strict=True)]
        self.index: dict[str, list[int]] = {}
        for e, bag in enumerate(self.bags):
            for t in bag:
                self.index.setdefault(t, []).append(e)
        self.filler_words = set().union(*self.fillers)
        #: What the lines of a message, or of a prompt or named filler, may consist of.
        own = {k: {x.partition(":")[0] for x in lines(t)} for k, t in (("message", messages_of), ("prompt", prompts_of), ("filler", prompts_of))}
        self.residue = {k: own[k] | {t for b, kind in zip(self.bags, self.kinds, strict=True) if (kind == "message") == (k == "message") for t in b} for k in own}
        #: Function words that no filler has.
        self.natural = self.terms.neutral - self.filler_words

    def retrieve(self, terms: set[str]) -> set[int]:
        """The exemplars of which enough distinct terms are there."""
        n = Counter(e for t in terms for e in self.index.get(t, ()))
        return {e for e, k in n.items() if k >= self.needed[e]}


def placeholder(text: str) -> bool:
    """An unfilled placeholder outside of code, quotations and formulas."""
    if not _any_shape.search(text):
        return False
    bare = _quoted.sub(" ", text)
    bare = bare if bare.isascii() else bare.translate(_fold)
    if any(p.search(bare) for p in CAPITALS.values()):
        return True
    low = bare.lower()
    return any(p.search(low) for p in PLACEHOLDERS.values())


_SCHEMA = "kind string, doc_id bigint, passage string, term string, n bigint"


def _scan(exemplars: Exemplars):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        passages = 0
        for batch in steps(batches):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc, cells in zip(ids, cell_lists(batch), strict=True):
                if doc is None:
                    continue
                marked = False
                for kind, text in cells:
                    if kind not in ("markdown", "raw"):
                        continue
                    passages += 1
                    tokens = terms_of(text)
                    distinct = set(tokens)
                    terms = exemplars.terms.of(distinct)
                    filler = distinct & exemplars.filler_words
                    df.update(terms)
                    df.update(filler - terms)
                    if not marked and placeholder(text):
                        marked = True
                        rows.append(("shape", doc, None, None, 1))
                    # what is repeated four times leaves three terms fewer
                    if exemplars.retrieve(terms) or len(filler) >= FILLER_TERMS or any(distinct.issuperset(s) for s in exemplars.short) or (len(tokens) >= len(distinct) + 3 and repeats(bare_lines(text))):
                        rows.append(("passage", doc, text, None, 1))
            if rows:
                yield _table(rows)
        yield _table([("df", None, None, t, n) for t, n in df.items()] + [("df", None, None, None, passages)])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())],
        ["kind", "doc_id", "passage", "term", "n"],
    )


def bare_lines(text: str) -> list[list[str]]:
    """The words of each line without tags, code, quotations and formulas."""
    return [terms_of(x) for x in _quoted.sub(" ", _tag.sub(" ", _block_tag.sub("\n", _head.sub(" ", text)))).split("\n")]


def _variable(word: str) -> bool:
    """A number, time or identifier: differs from page to page."""
    return any(c.isdigit() for c in word)


def contains_residue(text: str, exemplars: Exemplars, idf: dict[str, float], default: float) -> bool:
    """Whether a window of the passage contains a message or prompt, or is filler."""
    lines = bare_lines(text)
    return repeats(lines) or _is_filler(text, exemplars, idf, default) or _holds_message(lines, exemplars, idf, default)


def _holds_message(lines: list[list[str]], exemplars: Exemplars, idf: dict[str, float], default: float) -> bool:
    terms: list[str | None] = []
    line_of: list[int] = []
    for i, line in enumerate(lines):
        terms += exemplars.terms.reduce(line)
        line_of += [i] * len(line)
    here = {t for t in terms if t}
    candidates = exemplars.retrieve(here)
    if not candidates:
        return False
    where: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        if t in exemplars.index:
            where.setdefault(t, []).append(i)
    share: dict[tuple[str, int], tuple[int, int]] = {}

    def standing(kind: str, a: int, b: int) -> bool:
        """Residue of the kind makes up the lines from a to b."""
        own = every = 0
        for i in {line_of[k] for k in range(a, b + 1)}:
            if (kind, i) not in share:
                known = exemplars.residue[kind]
                # "your" is no more than a function word in a message
                row = [(t, w) for t, w in zip(exemplars.terms.reduce(lines[i]), lines[i], strict=True) if t and (kind != "message" or t != "yours")]
                content = [t for t, w in row if t in known or not _variable(w)]
                share[kind, i] = (sum(t in known for t in content), len(content))
            own += share[kind, i][0]
            every += share[kind, i][1]
        return own >= LINE_SHARE[kind] * every

    for e in candidates:
        bag = exemplars.bags[e]
        total = sum(idf.get(t, default) for t in bag)
        span = 3 * len(bag) + 6
        places = sorted(p for t in bag for p in where.get(t, ()))
        for k, start in enumerate(places):
            got: set[str] = set()
            mass = 0.0
            for p in places[k:]:
                if p - start >= span:
                    break
                if terms[p] not in got:
                    got.add(terms[p])
                    mass += idf.get(terms[p], default)
                    if mass >= CONTAINED * total and len(got) >= exemplars.needed[e]:
                        if standing(exemplars.kinds[e], start, p):
                            return True
                        break
    return False


_paragraph = re.compile(r"\n\s*\n")


def _is_filler(text: str, exemplars: Exemplars, idf: dict[str, float], default: float) -> bool:
    """A paragraph, or line of one, that lies within a filler's vocabulary."""
    plain = _quoted.sub(" ", _tag.sub(" ", _block_tag.sub("\n", _head.sub(" ", text))))
    for paragraph in _paragraph.split(plain):
        if not paragraph.lstrip().startswith("#") and tuple(terms_of(paragraph)) in exemplars.short:
            return True
        for piece in {paragraph, *paragraph.split("\n")}:
            own = [t for t in terms_of(piece) if not t.isdigit()]
            if len(own) < FILLER_WORDS:
                continue
            least = CONTAINED if exemplars.natural.intersection(own) else FILLER_BARE
            for filler in exemplars.fillers:
                weights = [idf.get(t, default) for t in own if t in filler]
                if len({t for t in own if t in filler}) < min(FILLER_TERMS, len(filler)):
                    continue
                # how common other words are isn't known unless they are terms; they weigh as the filler's do on average
                mean = sum(weights) / len(weights)
                others = sum(idf.get(t, mean) for t in own if t not in filler)
                if sum(weights) >= least * (sum(weights) + others):
                    return True
    return False


def repeats(lines: list[list[str]], longest: int = 3, least: int = 4) -> bool:
    """A line that is one unit of at most three words over and over: filler of unknown words."""
    for line in lines:
        for n in range(1, longest + 1):
            if len(line) >= least * n and all(line[i] == line[i - n] for i in range(n, len(line))) and not line[0].isdigit():
                return True
    return False


def find_residue(documents: DataFrame, exemplars: Exemplars | None = None) -> DataFrame:
    """(doc_id): the documents to leave out."""
    exemplars = exemplars or Exemplars()
    run = _scan(exemplars)
    with small_batches(documents.sparkSession):
        found = staged(documents.select("doc_id", "text", "cells").mapInArrow(run, _SCHEMA), "residue")
    counts = {r["term"]: r["n"] for r in found.filter("kind = 'df'").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per exemplar term
    passages = counts.pop(None, 0) or 1
    idf = {t: float(np.log(1 + passages / n)) for t, n in counts.items()}
    default = float(np.log(1 + passages))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [contains_residue(t, exemplars, idf, default) for t in b.column("passage").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(ok, pa.bool_()))], ["doc_id"])

    with small_batches(documents.sparkSession):
        texts = staged(found.filter("kind = 'passage'").select("doc_id", "passage").mapInArrow(judge, "doc_id bigint"), "judged")
    return found.filter("kind = 'shape'").select("doc_id").unionByName(texts).distinct()


def without_residue(documents: DataFrame, exemplars: Exemplars | None = None) -> DataFrame:
    """documents without the ones found."""
    return documents.join(find_residue(documents, exemplars), "doc_id", "left_anti")
