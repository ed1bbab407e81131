"""Template residue and error pages in text fields: placeholders, filler, failure messages, script notices.

Two character n-gram models are fitted: one on filler, notices and error messages written down or generated here,
one on all of the table's own lines, counted in tables of fixed size, from which lines that look like residue are taken out
again.
Windows over the likelihood ratio of the two localise residue in every line; a field's coverage is the share of its
characters within such windows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cookwright.plans.frames import spread

ORDER = 5
#: Lengths of the windows in bytes, each with the least mean of the log-likelihood ratios within it; and their least sum.
WINDOWS = ((6, 2.2), (10, 1.6), (20, 1.0), (36, 0.8))
LEAST = 9.0
#: Times that natural text is as likely as residue beforehand: a gram that it has now and then is no evidence.
PRIOR = 60.0
#: Occurrences of a gram in natural text of up to so many bytes that are put down to residue left in it; in proportion
#: beyond.
SPARE, SPARE_BYTES = 2, 2_900_000
#: A line of up to so many bytes is residue as a whole if its mean log ratio is this or more.
WHOLE, WHOLE_MEAN = 60, -1.8
#: Mean log ratio above which a whole line of the natural text is left out of it, and rounds of that.
ROUGH = 0.7
ROUNDS = 3
#: Occurrences, in a text of the natural one's size, that a gram's shorter one stands for.
SHRINK = 1.0
_SIZES = {1: 1 << 8, 2: 1 << 16, 3: 1 << 18, 4: 1 << 19, 5: 1 << 20}
_PAD = 4  # line feeds before each line
_MOST = 4.0  # bound of one character's log ratio

# What residue looks like, in four languages.
FILLER = """TODO|to be done|TODO: write this|TODO: add the steps here|TODO: fill in|tbc|n/a|null|null, null|NaN|NaN of undefined|undefined undefined|None|test|test test|test test 1|testing 123|asdf|asdf asdf|qwerty qwerty|xxx|xxxx xxxx|aaa bbb ccc|foo bar baz|
Coming soon|Coming soon: full text|More to come|Content goes here|Your text here|Insert text here|Sample text|Sample content|Dummy text|Dummy content for the layout|Placeholder|Placeholder text|This is a placeholder|CONTENT MISSING|TEXT MISSING|Replace this text|Replace me|Example text for layout only|Untitled document|Your text goes here|Add your text here|Add your description in this box.|Add ingredient|Add ingredients here|Add an ingredient|Write your recipe here|Type here|List item|New item|Item 1|Click to edit|Click to add text|Edit this text|Enter text here|
Text kommer|Text kommer här|Platshållare|Platshållartext|Exempeltext|Skriv texten här|Beskrivning saknas|Innehåll kommer snart|Fyll i text här|Kommer snart|Lägg till text här|Lägg till beskrivning|
Escribe aquí tu texto|Texto de ejemplo|Texto de relleno|Texto de prueba|Próximamente|Contenido de ejemplo|Falta la descripción|Inserte el texto aquí|Texto provisional|Añade aquí tu texto|Añadir descripción|
Platzhalter|Platzhaltertext|Hier Text einfügen|Hier Text eingeben|Beispieltext|Mustertext|Text folgt|Inhalt folgt|Beschreibung fehlt|Demnächst mehr|Zutat hinzufügen|Text hier hinzufügen|Beschreibung hinzufügen"""
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
FAILURES = """404: something went wrong|Page not found|The requested URL was not found on this server.|This page has moved or no longer exists.|This page does not exist|This page isn't available|Oops! Something went wrong|Oops! Something went wrong on our side.|Something went wrong. Please try again later.|An error occurred while loading the page|An unexpected error occurred|Error loading content|Error 403|Error: failed to load|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|Service unavailable|504 Gateway Timeout|Gateway timeout|Gateway timeout while loading the page|Request timed out|The request timed out|Connection refused|Connection reset by peer|Could not connect to the database|Error establishing a database connection|HTTP 403 Forbidden|HTTP 500 – the page cannot be displayed|The page cannot be displayed|403 Forbidden|Forbidden|Access denied|Access denied.|Access to this page has been denied|You do not have permission to view this page.|You do not have permission to view this recipe.|You are not authorized to view this page|Please log in again.|Please log in to continue|Your session has expired.|Session expired|Your session has timed out. Please log in again.|Too many requests|429 Too Many Requests|Request blocked|a1b2c3: request blocked|Your request has been blocked|Incident id: request blocked|Please verify that you are a human|Checking your browser before accessing|Are you a robot?|Fatal error: uncaught exception in main()|Fatal error: uncaught exception in render_page()|Fatal error: out of memory|Warning: undefined index name on line 12|Warning: undefined variable on line 3|Warning: division by zero in index.php on line 4|Notice: undefined index|Parse error: syntax error, unexpected|Traceback (most recent call last):|NullPointerException at line 7|java.lang.NullPointerException|TypeError: cannot read property of undefined|ReferenceError: x is not defined|SyntaxError: unexpected token|Stack trace:|Segmentation fault|Failed to load resource|Failed to fetch|File not found|Invalid request|Bad request|Method not allowed|The server encountered an error|Server error|Maintenance mode|This site is down for maintenance|Content unavailable|This content is not available|
Sidan finns inte|Sidan hittades inte|Ett fel uppstod|Ett fel har uppstått|Ett oväntat fel inträffade|Något gick fel|Fel vid inläsning av innehållet|Kunde inte ladda innehållet|Åtkomst nekad|Du saknar behörighet|Din session har gått ut|Logga in igen|Tjänsten är inte tillgänglig|Försök igen senare|Servern svarar inte|
La página no existe|No se pudo encontrar la página|Error al cargar la página|Ha ocurrido un error|Se ha producido un error|Algo salió mal|Acceso denegado|No tiene permiso para ver esta página|Su sesión ha caducado|Inicie sesión de nuevo|Servicio no disponible|Inténtelo de nuevo más tarde|Error interno del servidor|
Die Seite wurde nicht gefunden|Die angeforderte Seite existiert nicht|Ein Fehler ist aufgetreten|Fehler beim Laden des Inhalts|Fehler beim Laden der Seite|Keine Berechtigung|Ihre Sitzung ist abgelaufen|Bitte melden Sie sich erneut an|Dienst nicht verfügbar|Bitte versuchen Sie es später erneut|Interner Serverfehler|Etwas ist schiefgelaufen"""
NOTICES = """Please enable JavaScript|Please enable JavaScript to view this page.|JavaScript is disabled.|JavaScript is required|This page requires JavaScript to work|Turn on JavaScript and reload the page|Enable cookies to continue|Please enable cookies|Allow scripts and reload the page|Your browser does not support JavaScript|Your browser is out of date|To view this content, switch on scripting|noscript|<noscript>|Loading…|Loading... please wait|if nothing happens, check that JavaScript is on|
Aktivera JavaScript|Aktivera JavaScript för att visa sidan|JavaScript måste vara aktiverat|Slå på JavaScript|Din webbläsare stöder inte JavaScript|Den här sidan kräver JavaScript|Tillåt kakor och skript|
Active JavaScript|Active JavaScript para ver el contenido|Habilite JavaScript|Por favor, active JavaScript|Es necesario activar JavaScript|Su navegador no admite JavaScript|Esta página requiere JavaScript|Active las cookies|
Bitte JavaScript aktivieren|JavaScript ist deaktiviert|Diese Seite benötigt JavaScript|Aktivieren Sie JavaScript, um die Seite zu sehen|Ihr Browser unterstützt kein JavaScript|Bitte aktivieren Sie Cookies"""
FIELDS = "name title author date body content text description summary ingredient ingredients step steps directions method instructions qty quantity amount unit unit_label recipe recipe.title recipe.steps recipe_yield recipe.yield item item.name item.qty items line line_1 line_2 line_3 content.main content.body main header footer image image_url url link slug price tags category user user.name first_name last_name post.title page.title servings serves prep_time cook_time time value field field_1 variable var placeholder label key id method_text long_text source"
FORMS = ("{$}", "{{$}}", "{{ $ }}", "{{{$}}}", "[[$]]", "[$]", "[your $]", "<your $>", "<$>", "&lt;$&gt;", "<!-- $ -->", "<%= $ %>", "<% $ %>", "${$}", "#{$}", "{% include $ %}", "{% for s in $ %}", "{% $ %}", "%$%", "%%$%%", "@@$@@", "*|$|*")
SHOUTED = ("[INSERT $ HERE]", "[$]", "%$%", "$$$", "__$__", "{$}", "{{$}}", "<$>", "##$##", "INSERT $ HERE", "*|$|*")


# Patterns of residue by parts: one of each is taken, for as many lines as LINES_OF_A_PATTERN.
PATTERNS = (
    ("Please |You must |You need to |Kindly |To continue, ||", "enable|turn on|switch on|activate|allow", " JavaScript| scripts| cookies| scripting| JavaScript and cookies| cookies and scripts", "| in your browser| and reload| and reload the page| and try again| to continue| to view this page| to see the content| to read the recipe| to use this site| for this page to work|, then refresh|, then reload the page"),
    ("JavaScript|Javascript|Scripts|Scripting|Cookies", " is| are", " disabled| blocked| turned off| switched off| required| not supported| not allowed| not enabled", "| in your browser| by your browser| on this page|. Turn it on and reload.|; allow them to see the page."),
    ("This |The ", "site|page|app|recipe|website|content|list", " requires| needs| does not work without| cannot be shown without| only works with", " JavaScript| scripts| cookies| a newer browser", "|.| to be enabled| to work"),
    ("Your browser", " does not support| doesn't support| blocks| has disabled| cannot run", " JavaScript| scripts| cookies| this page", "|.|; turn them on| and cannot show this page|, so the content is hidden"),
    ("Loading|Loading…|Loading...|Please wait|Content hidden", "|, please wait| while scripts load|; check that scripts are enabled|: scripts needed|: enable JavaScript"),
    ("Aktivera |Slå på |Tillåt |Du måste aktivera |Vänligen aktivera ", "JavaScript|skript|kakor|JavaScript och kakor", "| i webbläsaren| för att fortsätta| för att se sidan| för att läsa receptet| och ladda om sidan"),
    ("Active |Habilite |Permita |Debe activar |Por favor, active ", "JavaScript|los scripts|las cookies|JavaScript y las cookies", "| en su navegador| para continuar| para ver la página| para ver la receta| y recargue la página"),
    ("Aktivieren Sie |Bitte erlauben Sie |Bitte schalten Sie |Sie müssen |Bitte aktivieren Sie ", "Skripte|Cookies|JavaScript im Browser|Skripte und Cookies", "| ein|, um fortzufahren|, um die Seite zu sehen| und laden Sie die Seite neu"),
    ("Add|Enter|Insert|Type|Write|Put|Place|Replace|Edit|Fill in", " your| the| some| an| a| this", " text| content| description| title| ingredients| ingredient| method| directions| steps| caption| note| item", " here| in this field| below| in the box| before you publish| later|"),
    ("Sample|Dummy|Placeholder|Example|Test|Default|Filler|Demo|Untitled", " text| content| title| line| sentence| paragraph| section| description| entry| item| block| heading| recipe", "| only| for layout| to be replaced| please ignore| 1"),
    ("Description|Content|Text|Ingredients|Directions|Title|Recipe|Method|Steps", " missing| to follow| to be added| coming soon| not yet available| goes in here| pending| will follow| to come"),
    ("Lägg till |Skriv |Fyll i |Ange |Klistra in ", "din |en |", "text|beskrivning|rubrik|ingrediens|titel", "| här| nedan| senare"),
    ("Añada |Escriba |Inserte |Introduzca |Añadir |Insertar ", "su |el |un |una |", "texto|descripción|título|ingrediente|contenido", "| aquí| en este campo| más tarde"),
    ("Hier |Bitte hier |", "Ihren Text |Text |Zutat |Beschreibung |Titel |Inhalt ", "eingeben|einfügen|eintragen|schreiben|ergänzen|ersetzen"),
    ("The page|This page|Page|The file|The recipe|The requested page|Content|Resource|The site|The service|Service", " not found| was not found| could not be loaded| cannot be displayed| is unavailable| is temporarily unavailable| does not exist| has been removed| timed out| is down| failed to load", "|.| on this server|, try again|. Please try again later.|, please reload"),
    ("Server|Database|Network|Connection|Gateway|Request|Session|Application|Script|Login", " error| failure| timeout| failed| refused| lost| expired| rejected| limit reached| denied| not available", "|.| (code 12)|, try again| while loading the page|; contact the administrator"),
    ("Something went wrong|An error occurred|An error has occurred|A problem occurred|Unexpected error", "| on our side| on our end| while loading| while loading the recipe| on the server", "|.|, please try again|. Try again later."),
    ("Too many |Unusual number of |Excessive ", "requests|attempts|connections|visits", "|.| from your address|, please wait|, try later"),
    ("Verify|Confirm|Prove|Please confirm|Check", " that you are| you are", " human| a human| not a robot| a person", "| to continue| to proceed| before continuing"),
    ("Fel vid |Ett fel uppstod vid |Det gick inte att ", "hämta |ladda |läsa in |visa ", "sidan|innehållet|receptet|filen"),
    ("Error al |No se pudo |Fallo al ", "cargar |mostrar |obtener |abrir ", "la página|la receta|el archivo|los datos"),
    ("Zugriff |Zugang |Verbindung |Anmeldung |Anfrage |Sitzung ", "verweigert|abgelehnt|gesperrt|fehlgeschlagen|abgelaufen|nicht erlaubt"),
    ("Acceso |Conexión |Solicitud |Sesión ", "denegado|denegada|rechazada|fallida|caducada|no permitido"),
    ("Åtkomst |Anslutning |Begäran |Sessionen ", "nekad|nekades|misslyckades|avbröts|har gått ut"),
    ("Fehler beim |Problem beim |Zeitüberschreitung beim ", "Laden |Anzeigen |Abrufen |Öffnen ", "der Seite|der Daten|des Rezepts|der Datei"),
)
LINES_OF_A_PATTERN = 120


def status_lines() -> list[str]:
    """The failures that servers report, by the standard's codes and phrases."""
    forms = ("{0} {1}", "{0}: {1}", "Error {0}", "HTTP {0} {1}", "Error {0}: {1}", "{1}", "HTTP error {0}", "Status {0} – {1}")
    return [f.format(int(c), c.phrase) for c in HTTPStatus if c >= 400 for f in forms]


def residue_lines(seed: int = 3) -> list[str]:
    """Training text of the residue class: fixed phrases and patterns of residue, runs of filler Latin, server failures,
    and placeholders of every form."""
    rng = random.Random(seed)
    out = [x.strip() for block in (FILLER, FAILURES, NOTICES) for x in block.split("|") if x.strip()] * 4
    for parts in PATTERNS:
        out += ["".join(rng.choice(p.split("|")) for p in parts) for _ in range(LINES_OF_A_PATTERN)]
    out += status_lines() + ["TBD", "undefined", "[object Object]", "Blindtext"] * 4
    latin = LATIN.split()
    for _ in range(400):
        k, n = rng.randrange(len(latin) - 3), rng.randint(3, 24)
        out.append(" ".join(latin[k : k + n]).capitalize() + rng.choice([".", "", "."]))
    for f in FIELDS.split():
        out += [form.replace("$", f) if form != "${$}" else "${" + f + "}" for form in FORMS]
        upper = f.replace(".", "_").upper()
        out += [form.replace("$", upper) if form != "$$$" else f"${upper}$" for form in SHOUTED]
    return out


#: Odd factors of the bytes of a gram: powers of one, so that sums of few bytes don't coincide.
_FACTORS = [np.uint32(pow(2_654_435_761, n, 1 << 32)) for n in range(1, ORDER + 1)]


def _bytes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' bytes, each behind ``_PAD`` line feeds and before one, and where each begins."""
    raw = [("\n" * _PAD + x + "\n").encode("utf-8", "replace") for x in lines]
    starts = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    return _folded(np.frombuffer(b"".join(raw), dtype=np.uint8)), starts


#: Bytes as the models see them: digits made equal, ASCII letters lower-cased.
_FOLD = np.array([48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _folded(b: np.ndarray) -> np.ndarray:
    return _FOLD[b]


def _grams(b: np.ndarray) -> dict[int, np.ndarray]:
    """The hash of the gram of each order that ends at each byte (the first few bytes are line feeds)."""
    out, h = {}, np.zeros(len(b), dtype=np.uint32)
    wide = b.astype(np.uint32)
    for n in range(1, ORDER + 1):
        back = np.empty_like(wide)
        back[: n - 1] = 10
        back[n - 1 :] = wide[: len(wide) - n + 1]
        h = h + (back + np.uint32(1)) * _FACTORS[n - 1]
        mixed = h ^ (h >> np.uint32(15))
        out[n] = (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(7)) & np.uint32(_SIZES[n] - 1) if n > 1 else wide
    return out


@dataclass(frozen=True)
class ResidueModel:
    """For each order, the log-likelihood ratio of each gram; NaN where neither text has it."""

    tables: dict

    def ratios(self, b: np.ndarray, grams: dict[int, np.ndarray] | None = None) -> np.ndarray:
        grams = grams or _grams(b)
        out = self.tables[1][grams[1]]
        for n in range(2, ORDER + 1):
            x = self.tables[n][grams[n]]
            out = np.where(np.isnan(x), out, x)
        return out

    def means(self, b: np.ndarray, starts: np.ndarray, grams: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """The mean log ratio of each whole line."""
        total = np.concatenate([[0.0], np.cumsum(self.ratios(b, grams), dtype=np.float64)])
        return (total[starts[1:]] - total[starts[:-1] + _PAD]) / np.maximum(1, np.diff(starts) - _PAD)

    def windows(self, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line its largest window mean over the threshold, and the number of its bytes that lie in windows over the threshold.

        A line that is shorter than a window is one window. Windows lie within their line.
        """
        r = self.ratios(b).astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(r)])
        line = np.repeat(starts[:-1] + _PAD, np.diff(starts))
        after = np.repeat(starts[1:], np.diff(starts))
        end = np.arange(1, len(b) + 1)
        best = np.full(len(b), -_MOST)
        covered = np.zeros(len(b) + 1, dtype=np.int64)
        for w, least in WINDOWS:
            begin = np.maximum(line, end - w)
            full = (end - begin == np.minimum(w, after - line)) & (end > line)
            mean = np.where(full, (total[end] - total[begin]) / np.maximum(1, end - begin), -_MOST)
            np.maximum(best, mean - least, out=best)
            hit = np.flatnonzero((mean >= least) & ((total[end] - total[begin]) >= LEAST))
            np.add.at(covered, begin[hit], 1)
            np.add.at(covered, end[hit], -1)
        if len(starts) < 2:
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        size = np.diff(starts) - _PAD
        mean = (total[starts[1:]] - total[starts[:-1] + _PAD]) / np.maximum(1, size)
        short = np.flatnonzero((size <= WHOLE + 1) & (size > 2) & (mean >= WHOLE_MEAN))
        np.add.at(covered, starts[short] + _PAD, 1)
        np.add.at(covered, starts[short + 1] - 1, -1)
        inside = np.cumsum(covered[:-1]) > 0
        return np.maximum.reduceat(best, starts[:-1]), np.add.reduceat(inside.astype(np.int64), starts[:-1])


#: Where the places of each order begin in one array of counts, whose last place counts the lines; and the places that
#: are sent and added up together.
_AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist()))
_PLACES = sum(_SIZES.values()) + 1
_PIECE = 8192


class _Counts:
    """Occurrences of every gram, and the place of its gram one shorter (the largest of those that share its place)."""

    def __init__(self) -> None:
        self.n, self.shorter = np.zeros(_PLACES, dtype=np.int64), np.full(_PLACES, -1, dtype=np.int32)

    def of(self, n: int) -> slice:
        return slice(_AT[n], _AT[n] + _SIZES[n])

    def add(self, lines: list[str], models: list[ResidueModel]) -> None:
        """Count the lines that no model takes for residue."""
        b, starts = _bytes(lines)
        grams = _grams(b)
        kept = np.ones(len(lines), dtype=bool)
        for model in models:
            kept &= model.means(b, starts, grams) < ROUGH
        own = np.repeat(kept, np.diff(starts))
        own[(starts[:-1, None] + np.arange(_PAD)).ravel()] = False  # grams of the line feeds before a line reach into another
        grams = {n: g[own].astype(np.int64) for n, g in grams.items()}
        for n, g in grams.items():
            self.n[self.of(n)] += np.bincount(g, minlength=_SIZES[n])
            if n > 1:
                np.maximum.at(self.shorter[self.of(n)], g, grams[n - 1].astype(np.int32))
        self.n[-1] += int(kept.sum())

    def pieces(self) -> pa.RecordBatch:
        at = np.unique(np.flatnonzero(self.n) // _PIECE)
        cut = lambda x: pa.array([x[_PIECE * k : _PIECE * (k + 1)].tobytes() for k in at], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), cut(self.n), cut(self.shorter)], names=["piece", "n", "shorter"])

    def merge(self, piece: int, n: bytes, shorter: bytes) -> None:
        own = slice(_PIECE * piece, _PIECE * (piece + 1))
        self.n[own] += np.frombuffer(n, dtype=np.int64)
        np.maximum(self.shorter[own], np.frombuffer(shorter, dtype=np.int32), out=self.shorter[own])


_PIECES = "piece int, n binary, shorter binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Counts()
    for b in batches:
        for piece in zip(*(c.to_pylist() for c in b.columns)):
            total.merge(*piece)
    yield total.pieces()


def _fit(natural: _Counts, prior: float, spare: float = 0) -> ResidueModel:
    """Odds of each gram, shrunk towards those of the gram one shorter where it is rare in both texts."""
    residue = _Counts()
    residue.add(residue_lines(), [])
    sizes = [max(1.0, float(x.n[x.of(1)].sum())) for x in (residue, natural)]
    spare *= max(1.0, sizes[1] / SPARE_BYTES)
    pull = SHRINK / min(sizes[1], 2e6)
    tables, odds = {}, np.ones(1)
    for n in range(1, ORDER + 1):
        counts = [x.n[x.of(n)].astype(np.float64) for x in (residue, natural)]
        shorter = natural.shorter[natural.of(n)]
        shorter = np.maximum(0, np.where(shorter < 0, residue.shorter[residue.of(n)], shorter))
        natural_count = counts[1] if n < 3 else np.maximum(0, counts[1] - spare)
        odds = (counts[0] / sizes[0] + pull * odds[shorter]) / (natural_count / sizes[1] * prior + pull)
        seen = counts[0] + counts[1] > 0
        tables[n] = np.where(seen, np.clip(np.log(np.maximum(odds, 1e-9)), -_MOST, _MOST), np.nan if n > 1 else 0).astype(np.float32)
    return ResidueModel(tables)


def _fitted(count: Callable[[list[ResidueModel]], _Counts]) -> ResidueModel:
    """Fit both models; natural lines that turn out to be residue are left out, in three rounds. ``count`` counts the
    natural lines that no model given takes for residue.

    A language's own marks and words (brackets in real remarks, numbers after ``page``, scripts of fonts) are learnt
    from the table, so that they don't count as residue. Without any natural line every seen gram speaks for residue.
    """
    models: list[ResidueModel] = []
    clean = count(models)
    for _ in range(ROUNDS):
        if not clean.n[-1]:
            break
        models.append(_fit(clean, 1.0))
        before, clean = clean, count(models)
        if clean.n[-1] == before.n[-1]:
            break
    return _fit(clean, PRIOR, SPARE)


def train(natural: list[str]) -> ResidueModel:
    """The model of some lines."""

    def count(models: list[ResidueModel]) -> _Counts:
        out = _Counts()
        for at in range(0, len(natural), 20_000):
            out.add(natural[at : at + 20_000], models)
        return out

    return _fitted(count)


def _lines(value) -> list[str]:
    return [x for v in (value if isinstance(value, list) else [value]) if v for x in v.split("\n") if x.strip()] if value else []


def fit(rows: DataFrame, arrays: list[str], texts: list[str]) -> ResidueModel:
    """The model of all lines of all rows: at most four passes that add up counts in tables of fixed size."""
    spark = rows.sparkSession
    rows = spread(rows.select(*arrays, *texts))

    def count(models: list[ResidueModel]) -> _Counts:
        shared = spark.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, lines, size = _Counts(), [], 0
            for batch in batches:
                for column in batch.columns:
                    for value in column.to_pylist():
                        mine = _lines(value)
                        lines += mine
                        size += sum(map(len, mine))
                        if size > _CHUNK:
                            found.add(lines, shared.value)
                            lines, size = [], 0
            if lines:
                found.add(lines, shared.value)
            yield found.pieces()

        total = _Counts()
        for r in rows.mapInArrow(run, _PIECES).repartition("piece").mapInArrow(_merged, _PIECES).toLocalIterator():
            total.merge(r.piece, r.n, r.shorter)
        shared.unpersist()
        return total

    return _fitted(count)


#: Bytes of lines that are scored at once.
_CHUNK = 400_000


def _scan(model: ResidueModel, arrays: list[str], texts: list[str]):
    names = [*arrays, *texts]

    def score(rows: list[tuple], lines: list[str]) -> Iterator[tuple]:
        best, covered = model.windows(*_bytes(lines))
        for ident, name, a, z in rows:
            got = int(covered[a:z].sum())
            if got:
                size = sum(len(x.encode("utf-8", "replace")) for x in lines[a:z])
                worst = a + int(np.argmax(covered[a:z]))
                yield ident, name, min(1.0, got / max(1, size)), lines[worst]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["row_ix", "field", "coverage", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows, lines, size = [], [], [], 0
            for ident, *values in zip(*(c.to_pylist() for c in batch.columns)):
                for name, value in zip(names, values):
                    if mine := _lines(value):
                        rows.append((ident, name, len(lines), len(lines) + len(mine)))
                        lines += mine
                        size += sum(map(len, mine))
                if size > _CHUNK:
                    found += score(rows, lines)
                    rows, lines, size = [], [], 0
            if lines:
                found += score(rows, lines)
            if found:
                yield batch_of(found)

    return run


def residue(rows: DataFrame, ident: str, arrays: list[str], texts: list[str], model: ResidueModel | None = None) -> DataFrame:
    """``row_ix, field, coverage, line``: one row for each field of a row that holds template residue.

    ``coverage`` is the share of the field's bytes within residue windows (1 for a field of nothing else), ``line``
    the line with most of it. Any row here holds some residue; :func:`exclude_spoilt` leaves out the fields that hold much.
    Null fields, null and blank lines give nothing; a repeated row gives its rows each time; a long text is scored
    whole. One pass without a shuffle, after those that fit the model to all rows.
    """
    model = model or fit(rows, arrays, texts)
    return spread(rows.select(F.col(ident).cast("long").alias(ident), *arrays, *texts)).mapInArrow(_scan(model, arrays, texts), "row_ix long, field string, coverage double, line string")


#: Coverage from which a field is spoilt as a whole.
SPOILT = 0.5


def exclude_spoilt(rows: DataFrame, found: DataFrame, ident: str, arrays: list[str], texts: list[str], coverage: float = SPOILT) -> DataFrame:
    """``rows`` with those fields null that residue covers to ``coverage`` or more, by the rows of :func:`residue`.

    Rows stay, also repeated ones and those with a null ident; a field with less residue stays as it is, for
    :func:`residue` has the line to be taken out.
    """
    bad = found.where(F.col("coverage") >= coverage).groupBy(F.col(ident).alias("ident")).agg(F.collect_set("field").alias("fields"))
    own, spoilt = (lambda c: F.col(f"own.`{c}`")), F.col("bad.fields")
    joined = rows.alias("own").join(bad.alias("bad"), own(ident).cast("long") == F.col("bad.ident"), "left")
    keep = lambda c: F.when(F.coalesce(F.array_contains(spoilt, F.lit(c)), F.lit(False)), F.lit(None)).otherwise(own(c)).alias(c)
    return joined.select(*(keep(c) if c in (*arrays, *texts) else own(c) for c in rows.columns))
