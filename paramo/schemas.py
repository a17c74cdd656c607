"""Declared tables: types, nullability, natural key and text lengths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, D, I, Y = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType()


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    key: tuple[str, ...]
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]


def _table(key: str, lengths: dict[str, int], *parts: tuple[str, T.DataType, bool]) -> Table:
    base = [("departamento", S, True), ("municipio", S, True), ("latitud", D, True), ("longitud", D, True),
            ("sector", S, False), ("fuente", S, False)]
    return Table(T.StructType([T.StructField(*c) for c in (*base, *parts)]), tuple(key.split()),
                 {"codigo_dane": 5, "departamento": 100, "municipio": 100, **lengths})


TABLES = {
    "tolls": _table(
        "idpeaje fecha_inicio categoria_tarifa", {"idpeaje": 20, "peaje": 150, "categoria_tarifa": 10},
        ("codigo_dane", S, True), ("fecha", Y, True), ("idpeaje", S, True), ("peaje", S, True), ("categoria_tarifa", S, True),
        ("fecha_inicio", Y, True), ("fecha_fin", Y, True), ("valor_tarifa", D, True),
        ("cantidad_trafico", I, True), ("cantidad_evasores", I, True), ("cantidad_exentos", I, True)),
    "index": _table(
        "fecha", {}, ("codigo_dane", S, False), ("fecha", Y, False), ("indice_total", D, True),
        ("total_fertilizantes", D, True), ("total_plaguicidas", D, True), ("total_otros", D, True)),
    "climate": _table(
        "codigo_estacion codigo_sensor fecha", {"codigo_estacion": 20, "codigo_sensor": 20, "tipo_variable": 50},
        ("codigo_dane", S, True), ("fecha", Y, True), ("codigo_estacion", S, True), ("nombre_estacion", S, True),
        ("codigo_sensor", S, True), ("tipo_variable", S, True), ("valor_observado", D, True),
        ("unidad_medida", S, True), ("zona_hidrografica", S, True)),
    "connectivity": _table(
        "codigo_dane anio tipo_conexion zona", {"tipo_conexion": 50, "zona": 20},
        ("codigo_dane", S, False), ("anio", I, False), ("fecha", Y, True), ("pct_hogares_internet", D, True),
        ("pct_hogares_celular", D, True), ("pct_hogares_pc", D, True), ("tipo_conexion", S, True),
        ("velocidad_mbps", D, True), ("poblacion", I, True), ("zona", S, True)),
    "education": _table(
        "codigo_dane anio nivel_educativo zona", {"nivel_educativo": 50, "zona": 20},
        ("codigo_dane", S, False), ("anio", I, False), ("fecha", Y, True), ("nivel_educativo", S, True),
        ("matriculados", I, True), ("matriculados_oficial", I, True), ("matriculados_privado", I, True),
        ("tasa_cobertura_neta", D, True), ("tasa_cobertura_bruta", D, True), ("tasa_aprobacion", D, True),
        ("tasa_desercion", D, True), ("zona", S, True)),
}
