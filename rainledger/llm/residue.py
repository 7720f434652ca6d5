"""Template residue, filler and error pages: masked segments grouped by hash across sources, then judged once each.

Documents are cut into segments in one pass. Only segments that hold a piece of some rule go on; they are
normalised (numbers, addresses and dates masked), grouped by the hash of what is left, and the phrase and
placeholder rules run over each distinct segment once, whatever the number of documents that carry it. The
verdicts meet the documents again by an equi-join on the hash.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.llm.pairs import small
from rainledger.storage import Workspace

#: Words that may stand beside the messages of an error page: a headline or a short teaser.
HEADLINE_WORDS = 24
#: A segment with a cue word is taken for a message of unknown wording if it stands in so many sources.
LEAST_SOURCES = 3

# Notations of unfilled fields, in any case unless noted.
_FIELDS = r"""(?i:\{\{|\{%|%\}|<%|%>|\$\{|\$[a-z_]{3,}\$|@@\w+@@|__[a-z_]{2,}__|<<\w+>>|\[\[\w+\]\]|&lt;[a-z_]{3,}&gt;|<[a-z_]+ (?:hier|here|ici)>|(?<![\w^\\])\{(?:[a-z_]{3,}|\d)\}|\[vul hier [^\]\n]{0,40}\]|\[insert [^\]\n]{0,40}\]|\[[^\]\n]{0,40} einf[üu]gen\]|\[[àa] compl[ée]ter[^\]\n]{0,40}\]|\([\w ]{1,40} invullen\)|\bXX-XX-20XX\b|\bundefined\b|\[object object\])|\bNaN\b|\bTODO\b|%[A-Z][A-Z_]{2,}%|#[A-Z][A-Z_]{2,}#|(?<![\w%])%[sSdD](?!\w)|\[(?!SIC\]|RED|NOOT|NVDR)[A-Z][A-Z_]{2,}\]"""
# Filler in the four languages.
_FILLER = r"""(?i)(?<![\p{L}\p{N}])(?:asdf|qwer\b|bla,? bla\b|x{3,} x{3,}|lorem ipsum\b|tekst tekst\b|test test\b|alinea zonder inhoud|inleiding volgt( nog)?\b|tekst volgt( nog)?\b|hier komt (de|het) (tekst|kop|artikel|inleiding|bericht)|voorbeeldtekst|(dummy|op)?vultekst\b|dummytekst|plaatshoudertekst|nog te vervangen\b|(body|headline|placeholder|dummy|sample) (copy|text)\b|(copy|text|headline) goes here|replace before publishing|blindtext|platzhalter|beispieltext|mustertext|hier (steht|kommt) der (text|artikel)|text folgt\b|absatz ohne inhalt|texte provisoire|texte? à remplacer|faux texte|texte d'exemple|texte à venir|ici vient le texte|paragraphe sans contenu|tussenkop tussenkop)|(^|\n)[ \t\r]*(tussenkop|zwischentitel|intertitre|crosshead)[ \t\r]*(\n|$)"""
# Beginnings of the words of the usual Latin filler.
_LATIN = r"""\b(lore|ipsu|dolo|amet|cons|adip|elit|eius|temp|inci|cidu|labo|magn|aliq|enim|mini|veni|quis|nost|exer|ulla|nisi|comm|comod|duis|aute|irur|repr|volu|veli|esse|cill|fugi|null|pari|exce|sint|occa|cupi|proi|sunt|culp|offi|dese|moll|anim|strud|sed|sit)\p{L}*"""
# Messages and notices, in lower case with numbers masked as 0.
_MESSAGES = [
    # missing pages
    r"(pagina|artikel|bericht|adres|bestand|link) niet gevonden", r"(page|article|address|story|file|link) not found", r"(seite|artikel|beitrag|adresse|datei) nicht gefunden", r"(page|article|adresse|fichier|lien) introuvable",
    r"de (gezochte|opgevraagde|gevraagde|door u (gekozen|gezochte|opgevraagde)) (pagina|link|site) (is er niet meer|is verwijderd|bestaat niet( meer)?)( of is verplaatst)?",
    r"the (page|article|link|story) you ((are looking|looked) for|requested|asked for|chose) (has been (removed|deleted|moved)|is no longer here|does not exist)( or has (been )?moved)?",
    r"die (angeforderte|gewünschte|gesuchte|aufgerufene) (seite|adresse) (existiert nicht( mehr)?|wurde gelöscht|wurde entfernt|gibt es nicht mehr|ist nicht mehr da)( oder wurde verschoben)?",
    r"la page (recherchée|demandée|choisie|souhaitée) (n'existe (pas|plus)|a été (supprimée|retirée|déplacée)|n'est plus (là|ici))( ou a été déplacée)?",
    r"((sorry|helaas|oeps|oops|leider|désolé|ups)[,!.]? )?(deze link werkt niet|wij vinden niets op deze plek|that link is broken|there is nothing (at|in) this (spot|place)|dieser link (funktioniert|geht) nicht|hier ist nichts zu finden|wir finden hier nichts|ce lien ne (fonctionne|marche) (pas|plus)|il n'y a rien (ici|à cet endroit)|nous ne trouvons rien (ici|à cet endroit))",
    # failures
    r"(er|hier) (is|ging) iets (mis|fout|verkeerd)( ?gegaan)?( aan onze kant)?", r"something (has gone|went|is) wrong( on our (side|end))?", r"(bei uns )?ist (ein fehler aufgetreten|etwas schief ?gelaufen)( bei uns)?", r"une erreur (est survenue|s'est produite)( de notre côté| chez nous)?", r"quelque chose s'est mal passé",
    r"probeer het later (opnieuw|nog eens)", r"kom (straks|later) terug", r"ververs de pagina", r"(please )?(try again later|come back (soon|later)|(refresh|reload) (the|this) page)", r"bitte (versuchen sie es später (noch einmal|erneut)|laden sie die seite neu|kommen sie später wieder)", r"veuillez (réessayer plus tard|recharger la page|actualiser la page|revenir plus tard)",
    r"storing in de databank", r"onbekende fout", r"interne (server)?fout", r"interner serverfehler", r"unbekannter fehler", r"(internal server|unknown|database) error", r"erreur (interne( du serveur)?|inconnue)", r"(fehler|störung) (in|mit) der datenbank", r"datenbankfehler", r"(panne|erreur) de la base de données", r"database (failure|fault)",
    r"(fout|error|fehler|erreur|http|statuscode:?|status code:?|code d'état:?|foutcode:?) 0", r"traceback: \w+ '\w+' line 0", r"at \w+\.\w+ \(\w+\.js:0\)", r"warning: \w+\(\): [\w ]+ in \S+ on line 0", r"ora-0: [\w ]+", r"no healthy upstream", r"(bad gateway|gateway time-?out|service unavailable|forbidden)",
    r"(het artikel|de inhoud|dit onderdeel|deze pagina|het bericht) kon niet worden (opgehaald|geladen|getoond|weergegeven)", r"(the (article|content|story)|this section|nothing) could not be (retrieved|loaded|shown|displayed)", r"nothing could be (retrieved|loaded|shown|displayed)", r"(der (beitrag|inhalt|artikel)|dieser (abschnitt|teil)|die seite) (konnte nicht (angezeigt|geladen|abgerufen) werden|kann nicht (dargestellt|angezeigt|geladen) werden)", r"(l'article|le contenu|cette (partie|rubrique)|cet élément) n'a pas pu être (chargée?|affichée?|récupérée?)",
    # access
    r"toegang geweigerd", r"geen toegang", r"u (bent niet bevoegd|heeft geen (rechten|toestemming)) om dit te bekijken", r"access (denied|refused)", r"you (are not (allowed|authori[sz]ed)|do not have (permission|the rights?)) to (view|see) this( page)?", r"zugriff verweigert", r"kein zugriff", r"(sie (sind nicht berechtigt|haben keine (rechte|berechtigung))[^.\n]{0,40})", r"accès (interdit|refusé)", r"vous n'(êtes pas autorisée?|avez pas (le droit|les droits|la permission))[^.\n]{0,40}",
    r"te veel (verzoeken|aanvragen) vanaf uw (netwerk|adres)", r"too many (hits|requests) from your (network|address)", r"zu viele (anfragen|zugriffe) (aus|von|über) ihre[rmn]? (netz(werk)?|adresse)", r"trop de (requêtes|demandes) (depuis|de|venant de) votre (réseau|adresse)",
    r"uw (sessie|aanmelding) is verlopen(, (meld u weer aan|log opnieuw in))?", r"your (session|login|sign-in) has (expired|ended)(, please (sign|log) in again)?", r"ihre (sitzung|anmeldung) ist (abgelaufen|beendet)(, bitte [^.\n]{0,30})?", r"votre (session|connexion) (a (expiré|pris fin)|est terminée)(, veuillez [^.\n]{0,30})?",
    r"deze (website|omgeving|dienst|site|pagina) is (\w+ )?niet (bereikbaar|beschikbaar)( wegens (onderhoud|drukte|een storing|overbelasting))?", r"th(is|e) (website|section|service|site|page) is (\w+ )?(offline|unavailable|down|not available)( (for|because of|due to) (maintenance|heavy traffic|a fault|an outage|overload))?", r"diese (seite|website|umgebung|anwendung) ist (\w+ )?(wegen (wartung|überlastung|einer störung) )?nicht (erreichbar|verfügbar)( wegen (wartung|überlastung|einer störung))?", r"(service|site|page) (momentanément |temporairement )?indisponible( pour (maintenance|travaux|cause de panne))?",
    # checks and scripts
    r"(toon aan|bevestig) dat u geen robot bent", r"(prove|confirm) that you are not a robot", r"(bitte )?(bestätigen|zeigen) sie,? dass sie kein roboter sind", r"(prouvez|confirmez) que vous n'êtes pas un robot",
    r"(even geduld|een ogenblik|(een )?moment), wij controleren uw browser", r"(one moment|just a moment|please wait|hold on), we are checking your browser", r"checking your browser( before you (proceed|continue|enter))?", r"(einen moment|bitte warten|augenblick)[^.\n]{0,10}, ihr browser wird (über)?geprüft", r"(un instant|patientez|un moment), nous (vérifions|contrôlons) votre navigateur",
    r"zonder scripts (is er niets te zien|blijft deze pagina leeg)", r"without scripts (there is nothing to see|this page (stays|remains) (empty|blank))", r"ohne skripte (bleibt diese seite leer|gibt es nichts zu sehen|ist nichts zu sehen)", r"sans scripts,? (cette page reste vide|il n'y a rien à voir)",
    r"uw browser (ondersteunt geen scripts|voert geen scripts uit)(; (wij kunnen niets tonen|deze site werkt daarom niet))?", r"your browser does not (run|support) scripts(, so (nothing can be (displayed|shown)|this site (cannot be shown|does not work)))?", r"ihr browser (führt keine skripte aus|unterstützt keine skripte)(; [^.\n]{0,50})?", r"votre navigateur (n'exécute pas|ne prend pas en charge) les scripts( ?; [^.\n]{0,50})?",
    r"(deze|dit) (pagina|kaart|toepassing|site|onderdeel) heeft javascript nodig", r"(this|the) (page|map|app|application|site|section) (needs|requires) javascript", r"you need (an engine for scripts|javascript)( to [^.\n]{0,30})?", r"diese (seite|karte|anwendung|website) (benötigt|braucht) javascript", r"cette (page|carte|application) a besoin de javascript",
    r"(schakel|zet) javascript (in|aan) om [^.\n]{0,40}", r"(please )?(enable|switch on|turn on|allow) javascript to [^.\n]{0,40}", r"bitte (aktivieren|erlauben) sie javascript,? um [^.\n]{0,40}", r"(bitte )?schalten sie javascript ein[^.\n]{0,40}", r"veuillez (activer|autoriser) javascript( pour [^.\n]{0,40})?",
    r"(zet|sta|schakel) scripts (aan|toe|in) en schakel uw advertentieblokker uit( om verder te gaan)?", r"(allow|enable|turn on) scripts and (disable|turn off|switch off) your ad ?blocker( to continue)?", r"(erlauben|aktivieren) sie skripte und (schalten|deaktivieren) sie ihren werbeblocker( aus)?[^.\n]{0,30}", r"(autorisez|activez) les scripts et désactivez votre bloqueur( de publicités?)?[^.\n]{0,30}",
]
_JSON_MESSAGE = r"\{\s*\"error\"[^\n]{0,80}?\}\}"
#: A word starts here; alternations are tried only at such places.
_START = r"(?<![\p{L}\p{N}])"
# What surrounds messages on such pages and is no content either.
_FRAME = r"\b(home|nieuws|weer|start|nachrichten|wetter|news|weather|accueil|infos|météo) ?\| ?[\p{L} |]{0,60}\b(contact|kontakt)\b|\bray id 0\b|\breference: ?0\b|\brequest-id=0\b|\btrace=0\b|\bserver port 0\b|\bcopyright 0\b|\bv0\.0\.0\b"
# Words of messages of unknown wording.
_CUE_WORDS = "pagina page seite site website browser navigateur server serveur fout error fehler erreur script scripts skripte javascript sessie session sitzung robot roboter toegang access zugriff accès netwerk network netzwerk réseau offline link lien login database databank datenbank".split()
# Pieces of the phrase rules, at least one of which any message holds (lower case, one blank between words).
_MESSAGE_PIECES = (
    "niet gevonden|not found|nicht gefunden|introuvable|gezochte|gevraagde|door u gekozen|page you|article you|link you|story you|angeforderte|gewünschte|gesuchte|aufgerufene|page recherch|page demand|page choisi|page souhait|"
    "deze link werkt|vinden niets op|link is broken|there is nothing|nothing could be|dieser link|nichts zu|hier nichts|ce lien ne|il n'y a rien|nous ne trouvons rien|iets mis|iets fout|iets verkeerd|something has gone|something went|something is|fehler aufgetreten|etwas schief|une erreur|s'est mal pass|"
    "het later|kom straks|kom later|ververs de|again later|come back|refresh th|reload th|es später|laden sie die|sie später|veuillez r|veuillez actualiser|storing in de|onbekende fout|interne |internal server|unknown error|database error|database fail|database fault|serverfehler|serverfout|unbekannter fehler|erreur interne|erreur inconnue|datenbank|base de donn|"
    "traceback:|.js:|warning: |ora-|healthy upstream|bad gateway|gateway time|service unavailable|forbidden|kon niet worden|could not be|konnte nicht|kann nicht|pas pu être|toegang|niet bevoegd|geen rechten|geen toestemming|access denied|access refused|you are not a|you do not have|zugriff|nicht berechtigt|keine rechte|keine berechtigung|accès interdit|accès refus|pas autoris|n'avez pas l|"
    "te veel verzoeken|te veel aanvragen|too many|zu viele|trop de|uw sessie|uw aanmelding|your session|your login|your sign-in|ihre sitzung|ihre anmeldung|votre session|votre connexion|niet bereikbaar|niet beschikbaar|offline|unavailable| down|not available|nicht erreichbar|nicht verfügbar|indisponible|geen robot|not a robot|kein roboter|pas un robot|"
    'uw browser|your browser|ihr browser|votre navigateur|zonder scripts|without scripts|ohne skripte|sans scripts|javascript|engine for scripts|zet scripts|sta scripts|schakel scripts|allow scripts|enable scripts|turn on scripts|skripte|les scripts|"error"'
).split("|") + [f"{word} {n}" for word in ("fout", "error", "fehler", "erreur", "http", "code", "code:", "état", "état:", "foutcode:") for n in range(10)]
# Pieces of the filler rules (lower case) and of the field rules (as written).
_FILLER_PIECES = (
    "asdf|qwer|bla bla|bla, bla|xxx|lorem ipsum|tekst tekst|test test|alinea zonder|inleiding volgt|tekst volgt|hier komt|voorbeeldtekst|vultekst|dummytekst|plaatshouder|te vervangen|body copy|body text|headline copy|headline text|placeholder|dummy copy|dummy text|sample copy|sample text|goes here|before publishing|blindtext|platzhalter|"
    "beispieltext|mustertext|hier steht|hier kommt|text folgt|absatz ohne|texte provisoire|à remplacer|faux texte|texte d'exemple|texte à venir|ici vient|paragraphe sans|tussenkop|zwischentitel|intertitre|crosshead|undefined|[object object]|invullen)| hier>| here>| ici>|[vul hier|[insert|einfügen]|einfugen]|[à compl|[a compl|xx-xx"
).split("|")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FIELD_PIECES = ["{{", "{%", "%}", "<%", "%>", "${", "@@", "__", "<<", "[[", "&lt;", "NaN", "TODO"] + [f"{sign}{c}" for sign in "%${[#" for x in _LETTERS + "_0123456789" for c in {x, x.upper()}]
_LATIN_STEMS = re.search(r"\((.*)\)", _LATIN).group(1).split("|")
_MARK = "\u0002"

_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|['’\u0300-\u036f])*")
#: Ends of segments: bars, ends of sentences that stand in no bracket, dashes between blanks.
_CUT = re.compile(r"\||(?<=[.!?])\s+(?![^\[\]{}]{0,80}[\]}])|\s[-–—]\s")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+")
_NUMBER = re.compile(r"\b(?=[a-f]*[0-9])[0-9a-f]{6,}\b|\d+")
_DATE = re.compile(r"\b0([-/.:]0)+")
_FRAMED = re.compile(_FRAME.replace(r"\p{L}", "[^\\W\\d_]").replace("[[^\\W\\d_] |]", "(?:[^\\W\\d_]|[ |])"))
_FRAME_PIECES = ("|", "ray id", "reference", "request-id", "trace=", "server port", "copyright", "v0", "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8", "v9")
_LATIN_WORD, _MESSAGE, _UNKNOWN, _FILL = 1, 2, 3, 4


def masked(text: str) -> str:
    """Lower case; addresses, dates, names of runs and numbers masked."""
    return _DATE.sub("0", _NUMBER.sub("0", _ADDRESS.sub("§", text.lower())))


class Segmenter:
    """Cuts a text into segments and tells which of them the rules have to see.

    The pieces are searched for by one automaton over the whole text (Aho and Corasick), so the pass
    is linear in the text and does not grow with the rules.
    """

    def __init__(self):
        self.lower, self.exact = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, pieces in ((_LATIN_WORD, _LATIN_STEMS), (_UNKNOWN, _CUE_WORDS), (_MESSAGE, _MESSAGE_PIECES), (_FILL, _FILLER_PIECES)):
            for piece in pieces:
                self.lower.add_word(piece, (self.lower.get(piece, ((), 0))[0] + (kind,), len(piece)))
        for piece in _FIELD_PIECES:
            self.exact.add_word(piece, True)
        self.lower.make_automaton()
        self.exact.make_automaton()

    def _kinds(self, segment: str, low: str) -> tuple[bool, bool]:
        """Whether field or filler rules, and whether message rules have to see a segment."""
        fill = next(self.exact.iter(segment), None) is not None
        latin, message = 0, False
        for end, (kinds, size) in self.lower.iter(low):
            for kind in kinds:
                if kind == _FILL:
                    fill = True
                elif kind == _MESSAGE:
                    message = True
                else:
                    start = end - size + 1
                    begins = not (start and low[start - 1].isalnum())
                    if kind == _LATIN_WORD:
                        latin += begins
                    else:
                        message = message or begins and not (end + 1 < len(low) and low[end + 1].isalnum())
        return fill or latin > 1, message

    def __call__(self, text: str) -> tuple[int, list[tuple[int, str, int, bool]]]:
        """(words, segments): words of the text without the frame of a page; (hash, segment, words, masked) of what the rules have to see.

        Segments for the field and filler rules are kept as written, those for the message rules masked. If more than
        HEADLINE_WORDS words stand in other segments than the latter, the document is no error page, and they are left out.
        """
        words, rest, out, messages = 0, 0, [], []
        for line in text.split("\n"):
            line = " ".join(line.split())
            if not line:
                continue
            low = line.lower()
            if any(piece in low for piece in _FRAME_PIECES) and _FRAMED.search(framed := masked(line)):
                line = _FRAMED.sub(" ", framed)
            for segment in _CUT.split(line):
                segment = segment.strip()
                if not segment:
                    continue
                n = len(_WORD.findall(segment))
                fill, message = self._kinds(segment, segment.lower())
                words += n
                if fill:
                    out.append((xxhash.xxh3_64_intdigest(segment) - (1 << 63), segment, n, False))
                if message:
                    plain = masked(segment)
                    messages.append((xxhash.xxh3_64_intdigest(plain, 1) - (1 << 63), plain, n, True))
                else:
                    rest += n
        return words, out + messages if rest <= HEADLINE_WORDS else out


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}[\p{L}\p{M}'’]*"))


def _latin_filler(text: Column) -> Column:
    """Whether a segment of at least four words is half made of Latin filler."""
    n = F.regexp_count(F.lower(text), F.lit(_LATIN))
    return (n >= 2) & (_words(text) >= 4) & (n >= 0.5 * _words(text))


def _segments(rows: DataFrame) -> DataFrame:
    """(row, id, source, words, segments) of the documents with at least one segment that the rules have to see."""

    def run(batches):
        cut = Segmenter()
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("text", pa.string()), ("words", pa.int32()), ("masked", pa.bool_())]))
        for batch in batches:
            made = [(i, *cut(t)) for i, t in enumerate(batch.column(3).to_pylist())]
            made = [m for m in made if m[2]]
            at = pa.array([i for i, *_ in made], pa.int64())
            segments = [[dict(zip(("hash", "text", "words", "masked"), s)) for s in own] for *_, own in made]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:3]], pa.array([n for _, n, _ in made], pa.int32()), pa.array(segments, kind)], names=["row", "id", "source", "words", "segments"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("row", "id", "source", "text").mapInArrow(run, f"row bigint, id {kind}, source string, words int, segments array<struct<hash:bigint,text:string,words:int,masked:boolean>>")


def judged_segments(segments: DataFrame) -> DataFrame:
    """(hash, masked, kind, left) of the distinct segments (hash, masked, text, words, sources) that a rule holds for.

    kind is `field`, `filler` or `message`; left are the words of the segment that stand outside the message. A masked
    segment with a message of the phrase rules is one wherever it stands; one with a cue word if it recurs in LEAST_SOURCES sources.
    """
    messages = f"{_START}(?:{'|'.join(_MESSAGES)})|{_JSON_MESSAGE}"
    text = F.col("text")
    bare = F.regexp_replace(text, messages, _MARK)
    fill = F.when(text.rlike(_FIELDS), "field").when(text.rlike(_FILLER) | _latin_filler(text), "filler")
    cue = text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_CUE_WORDS)})(?![\p{{L}}\p{{N}}])")
    told = F.contains("bare", F.lit(_MARK))
    kind = F.when(~F.col("masked"), fill).when(told | cue & (F.col("sources") >= LEAST_SOURCES), "message")
    left = F.when(told, _words(F.regexp_replace("bare", _FRAME, " "))).otherwise(0)
    return segments.withColumn("bare", F.when(F.col("masked"), bare)).select("hash", "masked", kind.alias("kind"), left.alias("left")).where("kind is not null")


def residue_documents(texts: DataFrame) -> DataFrame:
    """(id, kind) of the documents to leave out; kind is `field`, `filler` or `message`, the first that holds.

    texts: (id, source, text); other columns are ignored; null and blank texts have no row, repeated ids are
    judged row by row. A document with an unfilled field or filler anywhere is residue. A document is an error
    page or a script notice if it holds a message and little else: at most a headline's worth of words after
    the messages and the frame of the page are taken out, so a full article that mentions or carries a
    message stays. Messages are the segments that the phrase rules hold for and, beyond them, masked segments with a
    cue word whose hash recurs over LEAST_SOURCES sources (a null source counts as one), however long they are and
    however often a page repeats them.
    """
    ws = Workspace(texts.sparkSession, "residue")
    rows = texts.where("text is not null and trim(text) <> ''").select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("source", F.lit("")).alias("source"), "text")
    seen = ws.write("segments", _segments(rows))
    each = seen.select("row", "source", F.explode("segments").alias("s")).select("row", "source", "s.*")
    # by source first, so a segment that a third of all documents carry costs a row a task and source
    by = each.groupBy("hash", "masked", "source").agg(F.min("text").alias("text")).groupBy("hash", "masked").agg(F.min("text").alias("text"), F.count("*").alias("sources"))
    judged = ws.write("judged", judged_segments(by))
    met = each.join(small(judged), ["hash", "masked"])
    found = met.groupBy("row").agg(F.min(F.when(F.col("kind") != "message", F.col("kind"))).alias("kind"), F.count_if(F.col("kind") == "message").alias("n"), F.sum(F.when(F.col("kind") == "message", F.col("words") - F.col("left"))).alias("gone"))
    page = (F.col("n") > 0) & (F.col("words") - F.col("gone") <= HEADLINE_WORDS)
    return seen.select("row", "id", "words").join(found, "row").select("id", F.coalesce("kind", F.when(page, "message")).alias("kind")).where("kind is not null")


def without_residue(texts: DataFrame) -> DataFrame:
    """The rows (id, source, text, ...) that are no residue; null and blank texts stay."""
    gone = residue_documents(texts).select("id").distinct()
    return texts.join(gone, "id", "left_anti")
