"""Pinned public dictionaries, and their verified installation.

A fetcher gives bytes for an address; the one here reads local copies, since
nothing in this library opens a network connection.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..model import LexicalError

#: The public source, its revision, and for each locale the affix and word files, the license
#: notice and expression, the encodings of the two files, and the SHA-256 digests of the two files.
BASE = "https://raw.githubusercontent.com/LibreOffice/dictionaries"
REVISION = "f2ff99058268502bdcf4cad25c1ca2935ad8aa7d"
MAX_FILE_BYTES = 64 << 20
ENTRIES = [
    ("en_US", "en/en_US.aff", "en/en_US.dic", "en/license.txt", "GPL-2.0-only", "utf-8", "e746c882dd6f303c2c46e7452804b9201115a6942cfeb15f18f8edf774d2e24e", "f0b1a234bd178bdd01875b2a392a9647f888b8fe879f79c52aae62c2759b3647"),
    ("de_DE", "de/de_DE_frami.aff", "de/de_DE_frami.dic", "de/README_de_DE_frami.txt", "GPL-2.0-only OR GPL-3.0-only", "iso-8859-1", "646bf3333ac69c23e9d794533ee5241d6f755c359e8fe10a648f87613743d594", "4ca3c958b0e5545910999bc246f668840bf8ede3df8e5e6790d05edd5a586c38"),
    ("hu_HU", "hu_HU/hu_HU.aff", "hu_HU/hu_HU.dic", "hu_HU/README_hu_HU.txt", "MPL-2.0-or-later OR LGPL-3.0-or-later", "utf-8 with iso-8859-2", "f3a2748dd535cfde2142ab17d0f7f8e4787b03fb25a60829c69ac8d493db4802", "97293d670ad4a3b8e7eebef7e25c6e8e939b914c64b6b4672b2bf416b768f990"),
    ("es_ES", "es/es_ES.aff", "es/es_ES.dic", "es/LICENSE.md", "GPL-3.0-or-later OR LGPL-3.0-or-later OR MPL-1.1", "utf-8", "e73a9bf8e1383f4986a5dc9e2fbed49371c0c61f511c626d15586bd433c1cad9", "6975dddec3d5d2c676069537bc67b4b5f786c65c5d4cf6703a82acf779ac9ec1"),
    ("fr_FR", "fr_FR/dictionaries/fr.aff", "fr_FR/dictionaries/fr.dic", "fr_FR/dictionaries/README_dict_fr.txt", "MPL-2.0", "utf-8", "c176610cd5dc4846806a65ddd029f422d87978bf58f224aa44222662a16a2de5", "b78a868e31dd6e373b6c3217969afb898a9acde828a5e7ef97308da42218c88c"),
    ("it_IT", "it_IT/it_IT.aff", "it_IT/it_IT.dic", "it_IT/README_it_IT.txt", "GPL-3.0-only", "utf-8", "951afaa19272f13555b8823e8bcf9ccf78f8fe1a07835bdfb912ab3e4d537c2b", "bae1e3501dcd2a923669592493b3fde6c02aae7c7aab83bf5e5b49077e73dd64"),
    ("pt_BR", "pt_BR/pt_BR.aff", "pt_BR/pt_BR.dic", "pt_BR/README_pt_BR.txt", "LGPL-3.0-only OR MPL-1.1", "utf-8", "21d8ad2a769a60e17e2b5ea4ef11d4d593a58b9e2a82d642ef82d6a4c5523865", "a38bfb26b68ece2834e79fe83e48d5792652970ace12db89d1b9674bf9933183"),
    ("pt_PT", "pt_PT/pt_PT.aff", "pt_PT/pt_PT.dic", "pt_PT/LICENSES.txt", "GPL-2.0-only OR LGPL-2.1-only OR MPL-1.1", "utf-8", "975a209fcc892cb382fa5f34a28c391a39668661ce373ae071287809c5fcae24", "e29ba2d7aa8a2ad43e9cb46ac6473064b661545c87002aea90e18899d98d3cc9"),
    ("nl_NL", "nl_NL/nl_NL.aff", "nl_NL/nl_NL.dic", "nl_NL/LICENSE.txt", "BSD-3-Clause OR CC-BY-3.0", "utf-8", "f0233d4f721f4661cf5f4d05ed2739549322bf3b6b66764b55a38257e1e16e6f", "bc28af45307700a9927ad5719184da44dfd7eed4f707b8c1477f6d8a21b586a6"),
    ("pl_PL", "pl_PL/pl_PL.aff", "pl_PL/pl_PL.dic", "pl_PL/README_pl_PL.txt", "GPL-2.0-only OR LGPL-2.1-only OR MPL-1.1 OR Apache-2.0 OR CC-BY-4.0", "iso-8859-2", "82973651651aa930335c865b339b98db376ca3dbf3a661b70b9eeb71fdf41dca", "c0848440599eb88e5aca500418d5f389e562ec2c157b63dbe39d354658ffba49"),
    ("ru_RU", "ru_RU/ru_RU.aff", "ru_RU/ru_RU.dic", "ru_RU/README_ru_RU.txt", "BSD-3-Clause", "utf-8", "38ce7d4af78e211e9bafe4bf7e3d6a2c420591136cb738ec6648f8fdf6524cd7", "f6047416a0204adbecf3a451b874ec8a97ee37e2cbc714466ef04d8dbcc0d6fc"),
    ("tr_TR", "tr_TR/tr_TR.aff", "tr_TR/tr_TR.dic", "tr_TR/LICENSE", "MPL-2.0", "utf-8", "a04a227b2ee45574000b876a1afa982e3436d49ebb97a7a796ddc5ec0cc8191b", "48e5352c5770956b24f355265aef7649b25bcb4d933c0b254ea8b419c241f4bd"),
    ("ar", "ar/ar.aff", "ar/ar.dic", "ar/COPYING.txt", "GPL-2.0-or-later OR LGPL-2.1-or-later OR MPL-1.1", "utf-8", "cec30b8621001e49618feb05aec1984c5fcfbf7d2ec309901d5cbf66585217a3", "2a3e5367f61c1583734db9d66734f5603e6be5c2d227cf5c5cd7e4ca586e34fe"),
    ("uk_UA", "uk_UA/uk_UA.aff", "uk_UA/uk_UA.dic", "uk_UA/README_uk_UA.txt", "MPL-1.1", "utf-8", "2219dd15e9802adebc45722c60943b1472640260491af38dd3e43b07e75585e6", "2e5a9e67be63bdb089b3459addb5d71113319d13768e277bcae20f3cc1ad5a93"),
    ("sv_SE", "sv_SE/dictionaries/sv_SE.aff", "sv_SE/dictionaries/sv_SE.dic", "sv_SE/LICENSE_sv_SE.txt", "LGPL-3.0-only", "utf-8", "b721c9d44bee912feb182b601a1bc2ae3e7dffef660f4130cf2751867488a9dd", "384a2126eff333f5f6f9790ae892554546f53948d2988c600397cb5ad6ce66e8"),
    ("id_ID", "id/id_ID.aff", "id/id_ID.dic", "id/LICENSE-dict", "LGPL-3.0-only", "utf-8 and iso-8859-1", "c625d5b237a489c452cf1f9c666600103e8093667dff89e7030a24217995dc79", "775ff17a52801f3d2ee80120952fb44cc9bac6c3cf61740de775e439851a5803"),
    ("hi_IN", "hi_IN/hi_IN.aff", "hi_IN/hi_IN.dic", "hi_IN/COPYING", "GPL-2.0-only", "utf-8", "3ab96772dc3d1cdbec4141798efb8b7a091b92c9acbeb5dfd3c4998a5c508302", "1e01f962a02638ef73e3f8de3c44bfd854f7059d31c9fa96cff0b73a2840f9d9"),
    ("bn_BD", "bn_BD/bn_BD.aff", "bn_BD/bn_BD.dic", "bn_BD/COPYING", "GPL-2.0-only", "utf-8", "6beeacefab0f691cb415c9ab8de227091a3be65510c3d8c0479513b261e61b97", "cfc78b361861a726d22f0654d7c4e0b47f843c4a9e8b605c4c99e91ea683e116"),
]
COLUMNS = "locale string, aff_path string, dic_path string, notice_path string, license string, encoding string, aff_sha256 string, dic_sha256 string"


class InstallError(LexicalError):
    """A file that cannot be installed."""


class Fetcher(Protocol):
    """Gives the bytes behind an address."""

    def fetch(self, url: str, most: int) -> bytes: ...


@dataclass(frozen=True)
class LocalFetcher:
    """Reads copies below a folder that mirrors the public source."""

    root: Path

    def fetch(self, url: str, most: int) -> bytes:
        raw = (self.root / url.removeprefix(f"{BASE}/{REVISION}/")).read_bytes()
        if len(raw) > most:
            raise InstallError(f"{url} is over {most} bytes")
        return raw


def catalog(spark: SparkSession) -> DataFrame:
    """The pinned dictionaries as a table."""
    return spark.createDataFrame(ENTRIES, COLUMNS)


def find_locale(locale: str) -> tuple | None:
    return next((e for e in ENTRIES if e[0] == locale), None)


def problems(locale: str, name: str, url: str, digest: str, license_: str) -> list[str]:
    """What makes a manifest entry unsafe; none if it may be installed."""
    found = []
    if not re.fullmatch(r"[A-Za-z0-9_-]+", locale):
        found.append("locale")
    if not re.fullmatch(r"[^/\\\0]+", name) or name in (".", ".."):
        found.append("file name")
    if not re.fullmatch(r"https://[^/\s]+/\S*", url):
        found.append("address")
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", digest):
        found.append("digest")
    if not license_.strip():
        found.append("license")
    return found


def install_file(target: Path, raw: bytes, digest: str) -> bool:
    """Write verified bytes unless they are there already; True if written.

    The file appears whole or not at all and never replaces another.
    """
    if hashlib.sha256(raw).hexdigest() != digest.lower():
        raise InstallError(f"{target.name}: digest does not match")
    if target.exists():
        if hashlib.sha256(target.read_bytes()).hexdigest() == digest.lower():
            return False
        raise InstallError(f"{target.name}: another file is installed")
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_bytes(raw)
    try:
        os.link(part, target)  # fails where the target exists, unlike a rename
    except FileExistsError as error:
        if hashlib.sha256(target.read_bytes()).hexdigest() != digest.lower():
            raise InstallError(f"{target.name}: another file is installed") from error
        return False
    finally:
        part.unlink()
    return True


def install(locale: str, fetcher: Fetcher, folder: Path) -> tuple[Path, Path]:
    """Fetch, verify and install a pinned dictionary; its affix and word files."""
    entry = find_locale(locale)
    if entry is None:
        raise InstallError(f"unknown locale {locale}")
    placed = []
    for path, digest in ((entry[1], entry[6]), (entry[2], entry[7])):
        url, name = f"{BASE}/{REVISION}/{path}", path.rsplit("/", 1)[-1]
        if bad := problems(locale, name, url, digest, entry[4]):
            raise InstallError(f"{locale}: unsafe {', '.join(bad)}")
        install_file(folder / locale / name, fetcher.fetch(url, MAX_FILE_BYTES), digest)
        placed.append(folder / locale / name)
    return placed[0], placed[1]
