"""The sources' dialects: formats, headers in the order of preference, and where file names have the store.

All tables and patterns are fixed values of the retailers' published price lists. A field's headers are the source's own,
then those of its alternative layout; case and the marks of Croatian letters don't matter.
"""

from __future__ import annotations

from .delimited import Dialect

Columns = dict[str, tuple[str, ...]]

# The layout that several sources use as their alternative.
_PLAIN: Columns = {
    "external_id": ("Šifra",),
    "name": ("Naziv",),
    "category": ("Kategorija",),
    "brand": ("Marka",),
    "unit": ("Mjerna jedinica",),
    "unit_quantity": ("Količina",),
    "price": ("Cijena",),
    "discount_price": ("Akcijska cijena",),
    "discount_start": ("Početak akcije",),
    "discount_end": ("Kraj akcije",),
    "barcodes": ("Barkod",),
    "unit_price": ("Cijena za jedinicu mjere",),
    "lowest_price_30d": ("Najniža cijena u zadnjih 30 dana",),
    "anchor_price": ("Sidrena cijena",),
    "unit_price_base_quantity": ("Količina za jedinicu mjere",),
    "unit_price_base_unit": ("Jedinica mjere za cijenu",),
    "anchor_price_as_of": ("Datum sidrene cijene",),
}

_KONZUM: Columns = {
    "external_id": ("ŠIFRA PROIZVODA", "Code"),
    "name": ("NAZIV PROIZVODA", "Name"),
    "category": ("KATEGORIJA PROIZVODA", "Category"),
    "brand": ("MARKA PROIZVODA", "Brand"),
    "unit": ("JEDINICA MJERE", "Unit"),
    "unit_quantity": ("NETO KOLIČINA", "Quantity"),
    "price": ("MALOPRODAJNA CIJENA", "Price"),
    "discount_price": ("MPC ZA VRIJEME POSEBNOG OBLIKA PRODAJE", "Discount Price"),
    "discount_start": ("Discount Start",),
    "discount_end": ("Discount End",),
    "barcodes": ("BARKOD", "Barcode"),
    "unit_price": ("CIJENA ZA JEDINICU MJERE",),
    "lowest_price_30d": ("NAJNIŽA CIJENA U ZADNJIH 30 DANA",),
    "anchor_price": ("SIDRENA CIJENA",),
}

_LIDL: Columns = {
    "external_id": ("ŠIFRA", "Artikl"),
    "name": ("NAZIV", "Naziv artikla"),
    "category": ("KATEGORIJA_PROIZVODA", "Kategorija"),
    "brand": ("MARKA", "Robna marka"),
    "unit": ("JEDINICA_MJERE", "Jedinica mjere"),
    "unit_quantity": ("NETO_KOLIČINA", "Količina"),
    "price": ("MALOPRODAJNA_CIJENA", "Cijena"),
    "discount_price": ("MPC_ZA_VRIJEME_POSEBNOG_OBLIKA_PRODAJE", "Akcijska cijena"),
    "discount_start": ("Početak akcije",),
    "discount_end": ("Završetak akcije",),
    "barcodes": ("BARKOD", "GTIN"),
    "unit_price": ("CIJENA_ZA_JEDINICU_MJERE",),
    "lowest_price_30d": ("NAJNIZA_CIJENA_U_POSLJ._30_DANA",),
    "anchor_price": ("Sidrena_cijena_na_dan",),
}

_PLODINE: Columns = {
    "external_id": ("Sifra proizvoda",),
    "name": ("Naziv proizvoda",),
    "category": ("Kategorija proizvoda",),
    "brand": ("Marka proizvoda",),
    "unit": ("Jedinica mjere",),
    "unit_quantity": ("Neto kolicina",),
    "price": ("Maloprodajna cijena",),
    "discount_price": ("MPC za vrijeme posebnog oblika prodaje",),
    "barcodes": ("Barkod",),
    "unit_price": ("Cijena po JM",),
    "lowest_price_30d": ("Najniza cijena u poslj. 30 dana",),
    "anchor_price": ("Sidrena cijena",),
}

_INTERSPAR: Columns = {
    "external_id": ("šifra",),
    "name": ("naziv",),
    "category": ("kategorija proizvoda",),
    "brand": ("marka",),
    "unit": ("jedinica mjere",),
    "unit_quantity": ("neto količina",),
    "price": ("MPC (EUR)",),
    "discount_price": ("MPC za vrijeme posebnog oblika prodaje (EUR)",),
    "barcodes": ("barkod",),
    "unit_price": ("cijena za jedinicu mjere (EUR)",),
    "lowest_price_30d": ("Najniža cijena u posljednjih 30 dana (EUR)",),
    "anchor_price": ("sidrena cijena na 2.5.2025. (EUR)",),
}

_KAUFLAND: Columns = {
    "external_id": ("šifra proizvoda",),
    "name": ("naziv proizvoda",),
    "category": ("kategorija proizvoda",),
    "brand": ("marka proizvoda",),
    "unit": ("jedinica mjere",),
    "unit_quantity": ("neto količina(KG)",),
    "price": ("maloprod.cijena(EUR)",),
    "discount_price": ("akc.cijena, A=akcija",),
    "barcodes": ("barkod",),
    "unit_price": ("cijena jed.mj.(EUR)",),
    "lowest_price_30d": ("Najniža MPC u 30dana",),
    "anchor_price": ("Sidrena cijena",),
    "unit_price_base_quantity": ("kol.jed.mj.",),
    "unit_price_base_unit": ("jed.mj. (1 KOM/L/KG)",),
}

_EUROSPIN: Columns = {
    "external_id": ("ŠIFRA_PROIZVODA",),
    "name": ("NAZIV_PROIZVODA",),
    "category": ("KATEGORIJA_PROIZVODA", "KATEGORIJA"),
    "brand": ("MARKA_PROIZVODA", "MARKA"),
    "unit": ("JEDINICA_MJERE", "JM"),
    "unit_quantity": ("NETO_KOLIČINA",),
    "price": ("MALOPROD.CIJENA(EUR)", "MALOPROD_CIJENA"),
    "discount_price": ("MPC_POSEB.OBLIK_PROD", "MPC_POSEB_OBLIK_PROD"),
    "discount_start": ("POČETAK_AKCIJE",),
    "discount_end": ("KRAJ_AKCIJE",),
    "barcodes": ("BARKOD",),
    "unit_price": ("CIJENA_ZA_JEDINICU_MJERE",),
    "lowest_price_30d": ("NAJNIŽA_MPC_U_30DANA",),
    "anchor_price": ("SIDRENA_CIJENA",),
    "unit_price_base_quantity": ("KOLIČINA_ZA_JEDINICU_MJERE", "KOLICINA_ZA_JM"),
    "unit_price_base_unit": ("JEDINICA_MJERE_ZA_CIJENU", "JM_ZA_CIJENU"),
    "anchor_price_as_of": ("DATUM_SIDRENE_CIJENE",),
}

_KTC: Columns = {
    "external_id": ("Šifra proizvoda",),
    "name": ("Naziv proizvoda",),
    "category": ("Kategorija",),
    "brand": ("Marka proizvoda",),
    "unit": ("Jedinica mjere",),
    "unit_quantity": ("Neto količina",),
    "price": ("Maloprodajna cijena",),
    "discount_price": ("MPC za vrijeme posebnog oblika prodaje",),
    "barcodes": ("Barkod",),
    "unit_price": ("Cijena za jedinicu mjere",),
    "lowest_price_30d": ("Najniža cijena u posljednjih 30 dana",),
}

_METRO: Columns = {
    "external_id": ("SIFRA",),
    "name": ("NAZIV",),
    "category": ("KATEGORIJA",),
    "brand": ("MARKA",),
    "unit": ("JED_MJERE",),
    "unit_quantity": ("NETO_KOLICINA",),
    "price": ("MPC",),
    "discount_price": ("POSEBNA_PRODAJA",),
    "barcodes": ("BARKOD",),
    "unit_price": ("CIJENA_PO_MJERI",),
    "lowest_price_30d": ("NAJNIZA_30_DANA",),
    "anchor_price": ("SIDRENA",),
}

# Positions of the published workbook, then headers of the local ones.
_DM: Columns = {
    "external_id": ("1", "Šifra"),
    "name": ("0", "Naziv", "Naziv artikla"),
    "category": ("4", "Kategorija"),
    "brand": ("2", "Marka"),
    "unit": ("6", "Mjerna jedinica", "JM"),
    "unit_quantity": ("5", "Količina"),
    "price": ("9", "Cijena"),
    "discount_price": ("10", "Akcijska cijena", "Akcija"),
    "discount_start": ("Početak akcije",),
    "discount_end": ("Kraj akcije",),
    "barcodes": ("3", "Barkod", "EAN"),
    "unit_price": ("7", "Cijena za jedinicu mjere"),
    "lowest_price_30d": ("11", "Najniža cijena u zadnjih 30 dana"),
    "anchor_price": ("12", "Sidrena cijena"),
    "unit_price_base_quantity": ("Količina za jedinicu mjere", "Kolicina za JM"),
    "unit_price_base_unit": ("Jedinica mjere za cijenu", "JM za cijenu"),
    "anchor_price_as_of": ("Datum sidrene cijene",),
}

# Paths in an item.
_STUDENAC: Columns = {
    "store_identifier": ("store_id", "storeId", "Store/Id", "StoreId", "STORE_ID", "Poslovnica/Id"),
    "external_id": ("code", "Sifra"),
    "name": ("name", "Naziv"),
    "description": ("description", "Opis"),
    "category": ("category", "Kategorija"),
    "subcategory": ("subcategory", "Podkategorija"),
    "brand": ("brand", "Marka"),
    "unit": ("unit", "Jedinica"),
    "unit_quantity": ("quantity", "Kolicina"),
    "price": ("price", "Cijena"),
    "discount_price": ("discount_price", "AkcijskaCijena"),
    "discount_start": ("discount_start", "PocetakAkcije"),
    "discount_end": ("discount_end", "KrajAkcije"),
    "barcodes": ("barcode", "Barkod"),
    "image_url": ("image_url", "Slika"),
    "unit_price": ("unit_price", "CijenaZaJedinicuMjere"),
    "unit_price_base_quantity": ("unit_price_quantity", "JedinicaMjereKolicina"),
    "unit_price_base_unit": ("unit_price_unit", "JedinicaMjereOznaka"),
    "lowest_price_30d": ("lowest_price_30d", "NajnizaCijena30Dana"),
    "anchor_price": ("anchor_price", "SidrenaCijena"),
    "anchor_price_as_of": ("anchor_price_date", "SidrenaCijenaDatum"),
}

_TRGOCENTAR: Columns = {
    "external_id": ("sif_art",),
    "name": ("naziv_art",),
    "category": ("naz_kat",),
    "brand": ("marka",),
    "unit": ("jmj",),
    "unit_quantity": ("net_kol",),
    "price": ("mpc", "mpc_pop"),
    "discount_price": ("mpc_pop",),
    "barcodes": ("ean_kod",),
    "unit_price": ("c_jmj",),
    "lowest_price_30d": ("c_najniza_30",),
    "anchor_price": ("~c_[0-9]{6}",),
}


def _with_plain(own: Columns) -> Columns:
    return {field: own.get(field, ()) + _PLAIN.get(field, ()) for field in own | _PLAIN}


DIALECTS: dict[str, Dialect] = {
    d.name: d
    for d in (
        Dialect("konzum", _KONZUM, ",", "UTF-8", (r",(\d{4}),", r"\b(\d{4})\b")),
        Dialect(
            "lidl", _LIDL, ",", "windows-1250",
            (r"(?i)^lidl[_-]?\d{4}[_-]\d{2}[_-]\d{2}[_-](.+)\.csv$", r"(?i)^lidl[_-]?poslovnica[_-]?(.+)\.csv$", r"(?i)^lidl[_-]?(\d+)\.csv$", r"^([^_ ]+ [^_]+)_"),
        ),
        Dialect("plodine", _with_plain(_PLODINE), ";", "windows-1250", (r"^(?:[^_]*_){5}([^_]+)",), renamed=((r"(?i)^sidrena cijena na \d+\.\d+\.\d+.*", "Sidrena cijena"),)),
        Dialect("interspar", _with_plain(_INTERSPAR), ";", "UTF-8", (r"[_-](\d{4})[_-]", r"(?i)^(?:interspar|spar)[_-]?(.+?)(?:[_-]\d{4}[_-]\d{2}[_-]\d{2})?\.csv$")),
        Dialect("studenac", _STUDENAC, None, None, (r"-T(\d+)-",), tags=("product", "Product", "Proizvod", "proizvod", "item", "Item")),
        Dialect("kaufland", _with_plain(_KAUFLAND), "\t", "UTF-8", (r"_(\d{4})_\d{8}_", r"_(\d{4})_")),
        Dialect("eurospin", _EUROSPIN, ";", "UTF-8", (r"^[^-]*-([^-]+)",)),
        Dialect("dm", _DM, None, None, (), skipped_rows=3, store="dm_national"),
        Dialect("ktc", _KTC, ";", "windows-1250", (r"(PJ[\dA-Z]+-\d+)-\d{8}-\d{6}\.csv$", r"(PJ[\dA-Z]+)-\d+-\d{8}")),
        Dialect("metro", _with_plain(_METRO), ",", "UTF-8", (r"_S(\d+)_",), renamed=((r"(?i)^sidrena_\d{2}_\d{2}$", "SIDRENA"),)),
        Dialect("trgocentar", _TRGOCENTAR, None, None, (r"P(\d{3})",), tags=("cjenik",)),
    )
}
