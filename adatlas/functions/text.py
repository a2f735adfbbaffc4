"""Text rules as Column functions: brands, sectors, contacts, display forms. Nulls count as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from the end of a brand, accents, page hints, blocked domains.
LEGAL_FORMS = [
    "sociedad limitada", "sociedad anonima", "s l u", "s a u", "s l l", "s l", "s a", "s coop",
    "slu", "sau", "sll", "sl", "sa", "sccl", "scoop", "gmbh", "srl", "ltd", "inc", "bv", "nv", "spa", "ag",
]
AD_HINTS = ["publicidad", "anuncio", "www.", "solicite informacion", "distribuidor oficial", "sello de calidad", "siguenos en"]
BLOCKED_DOMAINS = ["proarquitectura.es", "promateriales.com", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "pinterest.com", "wordpress.org", "google.com"]
# Patterns of web addresses, e-mails and phones (Java syntax, Unicode classes on).
URL_PATTERN = r"(?iU)\b((?:https?://)?(?:www\.)?[a-z0-9][a-z0-9\-]+\.(?:com|es|net|org|eu|cat|info|io)(?:\.[a-z]{2})?)\b"
EMAIL_PATTERN = r"(?iU)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
PHONE_PATTERN = r"(?U)(?<!\d)(\+?\d{1,3}[\s.\-]?)?(\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}|\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}|\d{9})(?!\d)"
# Sector groups with the words that mark them, first match wins.
SECTORS = [
    ("Marketing y comunicacion", ["marketing", "seo", "sem ", "publicidad", "comunicacion", "agencia", "redes sociales", "branding", "medios", "prensa", "diseno"]),
    ("Tecnologia y software", ["software", "digital", "tecnolog", "tpv", "datos", "plataforma", "ecommerce", "saas", "sistema", "informatic", "aplicacion", "inteligencia artificial", " ia ", " app ", "web "]),
    ("Servicios profesionales", ["asesor", "consultor", "gestor", "juridic", "legal", "abogad", "financ", "seguro", "formacion", "recursos humanos", "rrhh", "franquici", "contab", "auditor"]),
    ("Bebidas", ["bebida", "vino", "cerveza", "agua", "refresco", "cafe", "licor", "destil", "zumo", "bodega", "vermut", "spirit", "drink", "barril"]),
    ("Alimentacion", ["aliment", "comida", "food", "queso", "carn", "charcuter", "jamon", "pan", "paste", "conserva", "congelad", "fruta", "verdura", "lacte", "embutid", "snack", "dulce", "choco", "aceite", "salsa", "marisco", "pescad", "gourmet", "ultramarinos"]),
    ("Maquinaria y equipamiento", ["maquina", "equipa", "horno", "freidora", "lavavaj", "refrigera", "frio", "vitrina", "cafetera", "dispensador", "utillaje", "fabrica", "industrial"]),
    ("Mobiliario y decoracion", ["mobil", "mueble", "decora", "interioris", "menaje", "vajilla", "cristaleria", "ilumina", "lampar", "textil hogar"]),
    ("Limpieza e higiene", ["limpieza", "higien", "desinfec", "lavanderia", "detergente"]),
    ("Bano y sanitarios", ["sanitari", "bano", "grifer", "ducha", "fontaner"]),
    ("Climatizacion y energia", ["climatiza", "calefac", "aire acondicionado", "energ", "solar", "fotovolt", "ventilacion", "hvac", "caldera"]),
    ("Construccion y materiales", ["construc", "material", "ceramic", "azulejo", "pavimento", "hormig", "acero", "aislamiento", "fachada", "cubierta", "ladrillo", "piedra", "madera", "carpinter", "obra", "revestimiento"]),
    ("Textil y uniformes", ["textil", "uniforme", "ropa", "vestuario", "calzado", "moda"]),
    ("Logistica y distribucion", ["logist", "distribu", "transporte", "almacen", "reparto", "suministr", "mayorista"]),
    ("Hosteleria y restauracion", ["hosteler", "restaura", "catering", "gastro"]),
]
NO_SECTOR, OTHER_SECTOR = "Sin sector", "Otros"
# Review reasons and their labels.
REVIEW_LABELS = {
    "low_conf": "Confianza baja", "magazine": "Coincide con el nombre de la revista", "short": "Nombre demasiado corto",
    "weird": "Caracteres extranos en el nombre", "variant": "Posible variante de otra marca", "partial_analysis": "Procede de un analisis parcial",
}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: White space in the sense of Unicode, and the four separators below 0x20.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(WHITE))


def canonical_brand(c: Column) -> Column:
    """The key under which spellings of one brand meet: lower case, few accents off, signs to spaces, one legal form off."""
    s = F.translate(F.lower(text(c)), "áéíóúüñçàè", "aeiouuncae")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " ")
    return strip(F.regexp_replace(strip(s), f" (?:{'|'.join(LEGAL_FORMS)})$", ""))


def compare_key(c: Column) -> Column:
    """The form in which brands are compared for variants: no spaces, hyphens, dots or accents."""
    return F.translate(F.regexp_replace(strip(F.lower(text(c))), r"(?U)[\s\-_.]+", ""), "áéíóúüñ", "aeiouun")


def sector_text(c: Column) -> Column:
    """The form of a sector in which words of rules are looked for: lower case, few accents off, a space at each end."""
    return F.concat(F.lit(" "), strip(F.translate(F.lower(text(c)), "áéíóúüñ", "aeiouun")), F.lit(" "))


def sector_group(c: Column) -> Column:
    """The broad sector of a free text; the first group with a word in it."""

    def group_of(padded: Column) -> Column:
        out = F.when(padded == "  ", NO_SECTOR)
        for group, words in SECTORS:
            found = F.lit(False)
            for word in words:
                found = found | F.contains(padded, F.lit(word))
            out = out.when(found, group)
        return out.otherwise(OTHER_SECTOR)

    return F.get(F.transform(F.array(sector_text(c)), group_of), F.lit(0))  # the text is made plain once


def domain_root(url: Column) -> Column:
    bare = F.lower(url)
    for prefix in ("www.", "https://", "http://"):
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return F.substring_index(bare, "/", 1)


def brand_key(root: Column) -> Column:
    return F.lower(strip(F.replace(F.substring_index(root, ".", 1), F.lit("-"), F.lit(" "))))


def title_case(c: Column) -> Column:
    """Words begin with a capital, and so do letters after digits (3m: 3M)."""
    return F.replace(F.initcap(F.regexp_replace(c, r"(?<=[0-9])(?=[a-z])", "\u0001 ")), F.lit("\u0001 "), F.lit(""))


def is_blocked(root: Column) -> Column:
    out = F.lit(False)
    for domain in BLOCKED_DOMAINS:
        out = out | F.endswith(root, F.lit(domain))
    return out


def is_ad_like(c: Column) -> Column:
    low, out = F.lower(text(c)), F.lit(False)
    for hint in AD_HINTS:
        out = out | low.contains(hint)
    return out


def first_phone(c: Column) -> Column:
    """The first phone of nine digits (of more, the last nine) that begins with 6 to 9, as written; else empty."""
    digits = lambda m: F.regexp_replace(m, r"(?U)\D", "")
    found = F.filter(F.regexp_extract_all(text(c), F.lit(PHONE_PATTERN), 0), lambda m: digits(m).rlike(r"[6-9]\d{8}$"))
    return strip(F.coalesce(F.get(found, F.lit(0)), F.lit("")))


def first_email(c: Column) -> Column:
    return F.regexp_extract(text(c), EMAIL_PATTERN, 0)


def best_text(embedded: Column, ocr: Column) -> Column:
    """Embedded text of more than 30 characters, else recognised text, else what is embedded."""
    return F.when(F.length(strip(text(embedded))) > 30, embedded).otherwise(F.coalesce(F.nullif(ocr, F.lit("")), text(embedded)))


def percent(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "alta").when(c >= 0.5, "media").otherwise("baja")


def review_label(reasons: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in REVIEW_LABELS.items() for x in pair])
    return F.array_join(F.transform(reasons, lambda r: F.coalesce(labels[r], r)), " · ")


def positive_int(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n)


def web_link(c: Column) -> Column:
    return F.when(text(c) == "", "").when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))


def export_name(c: Column) -> Column:
    return F.left(F.regexp_replace(text(c), r"(?U)[^\p{L}\p{N}_-]", ""), F.lit(32))


def appearance_prefix(job: Column, export: Column) -> Column:
    return F.coalesce(F.nullif(job, F.lit("")), F.nullif(export, F.lit("")), F.lit("export"))
