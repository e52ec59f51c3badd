"""Parameter files of dense matching, as text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the symbols behind the folders that all modes have, in their order; a name with a star is worked out of others
DIRECTIONS = (
    ("GammaCorrel", "2"), ("PdsF", "0.1"), ("NbDir", "7"),
    *((f"P{k}*", f" / ${{PdsF}} +   ${{PdsF}} / {k} ${{NbDir}}") for k in range(8)),
    ("VPds", "[${P0},${P1},${P2},${P3},${P4},${P5},${P6},${P7},${P6},${P7},${P4},${P3},${P2},${P1}]"),
    ("NbDirTot*", "* 2 ${NbDir}"), ("Regul*", "* ${RegulBase}  ? ${UseTeta} 3 1"),
)
# fixed values: all symbols of each mode, in their order
MODES = {
    "coregis": (
        ("Im1", "image1.tif"), ("Im2", "image2.tif"), ("Masq", "mask.stop"), ("DirMEC", "MEC/"), ("Pyr", "Pyram/"), ("Inc", "2.0"), ("Pas", "0.2"),
        ("Teta0", "0"), ("UseMasq", "true"), ("UseTeta", "false"), ("RegulBase", "0.3"), ("UseDequant", "true"), ("SzW", "4"), ("CorrelMin", "0.5"),
        *DIRECTIONS,
        ("SsResolOpt", "4"), ("SsResolOptInterm1*", "* 4 ${SsResolOpt}"), ("SsResolOptInterm2*", "* 2 ${SsResolOpt}"), ("Px1Moy", "0"),
        ("Px2Moy", "0"), ("ZoomInit", "1"), ("WithZ4*", " SupEq ${ZoomInit} 4"), ("WithZ2*", " SupEq ${ZoomInit} 2"),
    ),
    "displacement": (
        ("Im1", "image1.tif"), ("Im2", "image2.tif"), ("Masq", "mask.stop"), ("Dir", "MEC/"), ("Pyr", "PyramSat/"), ("Inc", "5"), ("Pas", "0.2"),
        ("Teta0", "0"), ("UseMasq", "true"), ("UseTeta", "false"), ("RegulBase", "0.2"), ("UseDequant", "true"), ("SzW", "3"), ("CorrelMin", "0.2"),
        *DIRECTIONS,
    ),
    "bathy": (
        ("Im1", "image1.tif"), ("Im2", "image2.tif"), ("Masq", "mask.stop"), ("Dir", "MEC/"), ("Pyr", "PyramSat/"), ("Inc", "5"), ("Pas", "0.2"),
        ("Teta0", "0"), ("UseMasq", "true"), ("UseTeta", "false"), ("RegulBase", "0.4"), ("UseDequant", "true"), ("SzW", "4"), ("CorrelMin", "0.5"),
        *DIRECTIONS,
    ),
}
# fixed values: the description of a mask of a whole image in its own geometry
MASK = (
    '<?xml version="1.0" ?>\n<FileOriMnt>\n     <NameFileMnt>./%s</NameFileMnt>\n     <NombrePixels>%d %d</NombrePixels>\n'
    "     <OriginePlani>0 0</OriginePlani>\n     <ResolutionPlani>1 1</ResolutionPlani>\n     <OrigineAlti>0</OrigineAlti>\n"
    "     <ResolutionAlti>1</ResolutionAlti>\n     <Geometrie>eGeomMNTFaisceauIm1PrCh_Px1D</Geometrie>\n</FileOriMnt>\n"
)


def symbols(mode: str) -> tuple[tuple[str, str], ...]:
    """Names and values of a mode's symbols in order; names that end in a star are worked out of others."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return MODES[mode]


def template(mode: str, steps: str = "") -> str:
    """The parameter text of a mode with its defaults; `steps`, the sections behind the symbols, are the user's."""
    lines = [f"<eSymb> {n[:-1]}={v} </eSymb>" if n.endswith("*") else f"<Symb> {n}={v} </Symb>" for n, v in symbols(mode)]
    return "\n".join(["<ParamMICMAC>", "<DicoLoc>", *lines, "</DicoLoc>", *([steps] if steps else []), "</ParamMICMAC>"])


def set_symbol(text: Column, name: str, value: Column) -> Column:
    """text with the whole value of a symbol replaced, decimals included, whatever it was; lines without it stay."""
    value = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(rf"(<Symb>\s*{name}=)[^<]*?\s*(</Symb>)"), F.concat(F.lit("$1"), value, F.lit(" $2")))


def set_inputs(text: Column, first: Column, second: Column, mask: Column) -> Column:
    """text with the two images and the mask's text file."""
    return set_symbol(set_symbol(set_symbol(text, "Im1", first), "Im2", second), "Masq", mask)


def parameter_file(
    mode: Column, window: Column | None = None, least_correlation: Column | None = None, search: Column | None = None, regularity: Column | None = None,
    steps: str = "",
) -> Column:
    """The template of each row's mode, with what is given in place of its defaults; other modes are an error."""
    out = F.raise_error(F.concat(F.lit("unknown mode: "), mode)).cast("string")
    for name in MODES:
        out = F.when(mode == name, F.lit(template(name, steps))).otherwise(out)
    for name, value in (("SzW", window), ("CorrelMin", least_correlation), ("Inc", search), ("RegulBase", regularity)):
        if value is not None:
            out = set_symbol(out, name, value)
    return out


def mask_file(name: Column, cols: Column, rows: Column) -> Column:
    """Description of a mask raster of that size."""
    return F.format_string(MASK, name, cols, rows)
