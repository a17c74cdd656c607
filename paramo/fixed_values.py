"""Constants, code tables and word lists that results depend on.

Everything here is data, not logic.  Tables are small by construction (all under
200 rows), which is the size bound that lets operators broadcast them.
"""

from __future__ import annotations

# --- Fixed values: climate normals -------------------------------------------------
RAIN_NORMAL_MM = 150.0
TEMP_NORMAL_C = 22.0
# share of the normal, January to December
RAIN_PATTERN = [0.53, 0.73, 0.97, 1.27, 1.33, 0.87, 0.67, 0.77, 1.13, 1.33, 1.10, 0.70]
TEMP_PATTERN = [1.00, 1.02, 1.04, 1.04, 1.02, 1.00, 0.98, 0.98, 1.00, 1.00, 0.98, 0.98]
RAIN = "precipitacion_mm"
TEMP = "temperatura_c"
# variable -> (lowest, lowest allowed?, exclusive highest)
PLAUSIBLE = {RAIN: (0.0, True, 1000.0), TEMP: (-5.0, False, 45.0)}
MIN_REAL_MONTHS = 3

# --- Fixed values: score, labels ---------------------------------------------------
CUT_MEDIUM = 25.0
CUT_HIGH = 42.0
LABELS = {0: "BAJA", 1: "MEDIA", 2: "ALTA"}
LABEL_COLORS = {0: "#3FA796", 1: "#F2A541", 2: "#C0392B"}
HARVEST_MONTHS = [9, 10, 11]
PEAK_INFLATION_YEARS = [2022, 2023]
POST_INFLATION_YEARS = [2024, 2025]

# --- Fixed values: features, in training order -------------------------------------
FEATURES = [
    "upra_indice_total",
    "upra_var_mensual_pct",
    "upra_fertilizantes",
    "upra_plaguicidas",
    "ideam_precipitacion_mm",
    "ideam_precipitacion_anomalia",
    "ideam_temperatura_c",
    "ideam_temperatura_anomalia",
    "mes",
    "anio",
]
MEASURES = FEATURES[:8]

# readable feature names used by the attribution texts (our wording)
FEATURE_TITLES = {
    "upra_indice_total": "Índice de precios de insumos",
    "upra_var_mensual_pct": "Variación mensual del índice (%)",
    "upra_fertilizantes": "Subíndice de fertilizantes",
    "upra_plaguicidas": "Subíndice de plaguicidas",
    "ideam_precipitacion_mm": "Lluvia del mes (mm)",
    "ideam_precipitacion_anomalia": "Lluvia frente a la normal",
    "ideam_temperatura_c": "Temperatura del mes (°C)",
    "ideam_temperatura_anomalia": "Temperatura frente a la normal",
    "mes": "Mes",
    "anio": "Año",
}

# --- Fixed values: rule thresholds -------------------------------------------------
FERTILIZER_ALERT = 130.0
FERTILIZER_HIGH_FACTOR = 1.15
MONTHLY_CHANGE_ALERT = 5.0
RAIN_LOW_MEAN = 5.0
RAIN_LOW_MAX = 10.0
RAIN_HIGH_MEAN = 150.0
TEMP_HIGH_MEAN = 30.0
EVASION_ALERT_PCT = 15.0
EVASION_NOTE_PCT = 10.0
Z_MODERATE, Z_HIGH, Z_CRITICAL = 2.0, 2.5, 3.0

# --- Fixed values: chat intents, first listed wins ties ----------------------------
INTENTS = ["trafico", "precios", "clima", "resumen", "ayuda", "ivt", "anomalia", "forecast"]
UNKNOWN_INTENT = "desconocido"
INTENT_KEYWORDS = {
    "trafico": ["trafico", "peaje", "vehiculo", "transito", "carretera", "ani"],
    "precios": ["precio", "insumo", "fertilizante", "plaguicida", "upra", "agricola"],
    "clima": ["lluvia", "precipitacion", "temperatura", "clima", "ideam", "sequia"],
    "resumen": ["resumen", "estado", "cuantos", "registros", "mtu"],
    "ayuda": ["ayuda", "puedes", "funciona", "ejemplo", "capacidades"],
    "ivt": ["vulnerabilidad", "ivt", "territorial", "prediccion", "riesgo"],
    "anomalia": ["anomalia", "alerta", "raro", "atipico", "outlier"],
    "forecast": ["proximo", "futuro", "tendencia", "proyeccion", "forecast"],
}
REGION_NAMES = [
    "antioquia", "cundinamarca", "valle", "atlántico", "atlantico",
    "bolívar", "bolivar", "santander", "nariño", "narino", "cauca",
    "tolima", "huila", "boyacá", "boyaca", "caldas", "risaralda",
    "quindío", "quindio", "meta", "cesar", "magdalena", "córdoba",
    "cordoba", "sucre", "guajira", "chocó", "choco", "casanare",
]

# default phrase corpus for the cosine classifier (our own phrases; callers may pass theirs)
CORPUS = [
    ("total de vehículos en los peajes de la región", "trafico"),
    ("flujo vehicular por categoría y peaje", "trafico"),
    ("porcentaje de evasión en las carreteras", "trafico"),
    ("peaje con mayor tránsito del mes", "trafico"),
    ("cuántos camiones cruzaron la vía", "trafico"),
    ("índice de precios de los insumos", "precios"),
    ("cuánto vale el bulto de fertilizante", "precios"),
    ("subió el costo de los plaguicidas", "precios"),
    ("variación del precio agrícola frente al mes pasado", "precios"),
    ("precio de semillas y abonos", "precios"),
    ("lluvia acumulada en los últimos días", "clima"),
    ("temperatura media de la estación", "clima"),
    ("milímetros de precipitación por departamento", "clima"),
    ("hay riesgo de sequía o heladas", "clima"),
    ("cómo estará el tiempo mañana", "clima"),
    ("número de registros cargados por tabla", "resumen"),
    ("estado de la carga de datos", "resumen"),
    ("qué fuentes están disponibles", "resumen"),
    ("última fecha de actualización de los datos", "resumen"),
    ("qué preguntas respondes", "ayuda"),
    ("necesito ayuda para empezar", "ayuda"),
    ("muéstrame un ejemplo de consulta", "ayuda"),
    ("cómo se usa el asistente", "ayuda"),
    ("nivel de vulnerabilidad del territorio", "ivt"),
    ("qué puntaje territorial tiene mi zona", "ivt"),
    ("clasificación de riesgo alta media o baja", "ivt"),
    ("índice de vulnerabilidad de este período", "ivt"),
    ("períodos con valores atípicos", "anomalia"),
    ("hay alertas o datos raros", "anomalia"),
    ("detección de valores extremos", "anomalia"),
    ("qué mes se sale de lo normal", "anomalia"),
    ("proyección para los próximos meses", "forecast"),
    ("pronóstico de la serie a futuro", "forecast"),
    ("tendencia esperada del índice", "forecast"),
    ("cuánto subirá el próximo semestre", "forecast"),
]

# --- Fixed values: municipality name (lower case) -> code ---------------------------
MUNICIPALITY_CODES = {
    "medellín": "05001", "medellin": "05001", "bello": "05088",
    "itagüí": "05360", "itagui": "05360", "envigado": "05266", "rionegro": "05615",
    "marinilla": "05440", "barbosa": "05079", "copacabana": "05212", "girardota": "05310",
    "bogotá": "11001", "bogota": "11001", "bogotá d.c.": "11001",
    "cali": "76001", "buenaventura": "76113", "palmira": "76520",
    "tuluá": "76834", "tulua": "76834", "cartago": "76147",
    "barranquilla": "08001", "soledad": "08758",
    "cartagena": "13001", "turbana": "13780",
    "zipaquirá": "25899", "zipaquira": "25899", "chía": "25175", "chia": "25175",
    "cajicá": "25126", "cajica": "25126", "soacha": "25754", "tenjo": "25799",
    "facatativá": "25269", "facatativa": "25269",
    "bucaramanga": "68001", "floridablanca": "68276", "girón": "68307", "giron": "68307",
    "cúcuta": "54001", "cucuta": "54001",
    "tunja": "15001", "duitama": "15238", "sogamoso": "15759",
    "manizales": "17001", "pereira": "66001", "dosquebradas": "66170", "armenia": "63001",
    "ibagué": "73001", "ibague": "73001", "neiva": "41001", "pasto": "52001",
    "popayán": "19001", "popayan": "19001",
    "valledupar": "20001", "bosconia": "20060", "chimichagua": "20238",
    "santa marta": "47001", "ciénaga": "47189", "cienaga": "47189", "sevilla": "47660",
    "montería": "23001", "monteria": "23001", "sincelejo": "70001",
    "villavicencio": "50001", "yopal": "85001", "arauca": "81001", "mocoa": "86001",
    "leticia": "91001", "quibdó": "27001", "quibdo": "27001", "riohacha": "44001",
}

# --- Fixed values: toll site (lower case) -> code, region, municipality, lat, lon ----
TOLL_SITES = {
    "la ye": ("05001", "Antioquia", "Medellín", 6.2518, -75.5636),
    "marinilla": ("05440", "Antioquia", "Marinilla", 6.1763, -75.3331),
    "santuario": ("05736", "Antioquia", "Santuario", 6.1397, -75.2715),
    "el higado": ("05088", "Antioquia", "Bello", 6.3397, -75.5560),
    "hatillo": ("05088", "Antioquia", "Bello", 6.3900, -75.5630),
    "tribunas": ("66001", "Risaralda", "Pereira", 4.7967, -75.6942),
    "la paila": ("76233", "Valle del Cauca", "Dagua", 3.7186, -76.3936),
    "boquía": ("63001", "Quindío", "Armenia", 4.5339, -75.6810),
    "cruces": ("17001", "Caldas", "Manizales", 5.0703, -75.5136),
    "alto de las palmas": ("05001", "Antioquia", "Medellín", 6.2000, -75.4800),
    "chimichagua": ("20238", "Cesar", "Chimichagua", 9.2547, -73.8175),
    "siberia": ("25754", "Cundinamarca", "Tenjo", 4.8697, -74.1878),
    "chia": ("25175", "Cundinamarca", "Chía", 4.8620, -74.0588),
    "tobia grande": ("25658", "Cundinamarca", "Quebradanegra", 5.0614, -74.4606),
    "la virgen": ("25126", "Cundinamarca", "Cajicá", 4.9267, -74.0264),
    "corredor norte": ("11001", "Bogotá D.C.", "Bogotá", 4.6097, -74.0817),
    "fontibón": ("11001", "Bogotá D.C.", "Bogotá", 4.6926, -74.1469),
    "zipaquirá": ("25899", "Cundinamarca", "Zipaquirá", 5.0228, -74.0077),
    "briceño": ("05107", "Antioquia", "Briceño", 7.0967, -75.5261),
    "río grande": ("05001", "Antioquia", "Medellín", 6.5500, -75.6000),
    "puerto araujo": ("13300", "Bolívar", "Hatillo de Loba", 8.9594, -74.0669),
    "turbana": ("13780", "Bolívar", "Turbana", 10.3000, -75.3833),
    "ciénaga": ("47189", "Magdalena", "Ciénaga", 11.0048, -74.2507),
    "sevilla": ("47660", "Magdalena", "Sevilla", 10.5683, -74.1131),
    "bosconia": ("20060", "Cesar", "Bosconia", 9.9756, -73.8939),
    "la pintada": ("05541", "Antioquia", "La Pintada", 5.7514, -75.5994),
    "amagá": ("05030", "Antioquia", "Amagá", 6.0367, -75.7028),
    "barbosa": ("05079", "Antioquia", "Barbosa", 6.4367, -75.3319),
    "la miel": ("17174", "Caldas", "Samaná", 5.6047, -74.9261),
    "km 18 buenaventura": ("76113", "Valle del Cauca", "Buenaventura", 3.8878, -76.9200),
}

# --- Fixed values: expected rates by region -----------------------------------------
DEFAULT_REGION = "_default"
# region -> % households with internet, mobile phone, computer
CONNECTIVITY_RATES = {
    "Bogota D.C.": (78.2, 95.1, 52.3),
    "Antioquia": (62.4, 92.8, 38.7),
    "Valle": (61.1, 91.5, 37.2),
    "Cundinamarca": (55.8, 89.3, 32.1),
    "Santander": (54.3, 88.7, 30.8),
    "Atlantico": (52.1, 89.2, 28.4),
    "Boyaca": (44.2, 85.6, 22.1),
    "Tolima": (43.8, 84.9, 21.7),
    "Huila": (42.5, 83.2, 20.3),
    "Narino": (35.6, 80.1, 15.8),
    "Cauca": (33.2, 78.4, 14.2),
    "Choco": (21.3, 68.7, 8.4),
    "Vaupes": (12.4, 55.3, 4.1),
    DEFAULT_REGION: (40.0, 82.0, 18.0),
}
RURAL_FIXED_FACTOR = 0.42
RURAL_MOBILE_FACTOR = 0.8
# region -> net coverage % for the four levels
EDUCATION_LEVELS = ["preescolar", "primaria", "secundaria", "media"]
EDUCATION_RATES = {
    "Bogota D.C.": (62.1, 95.4, 82.3, 48.7),
    "Antioquia": (58.4, 93.2, 79.1, 44.3),
    "Valle": (55.8, 91.8, 76.4, 41.2),
    "Cundinamarca": (54.2, 90.7, 74.8, 39.6),
    "Santander": (53.1, 89.4, 73.2, 38.1),
    "Atlantico": (51.7, 88.9, 71.6, 36.8),
    "Boyaca": (48.3, 87.2, 68.4, 33.2),
    "Tolima": (47.1, 86.8, 67.1, 31.9),
    "Huila": (46.4, 86.1, 65.8, 30.7),
    "Narino": (43.8, 84.3, 61.2, 27.4),
    "Cauca": (42.1, 83.7, 59.8, 25.6),
    "Choco": (36.4, 78.2, 48.3, 18.9),
    DEFAULT_REGION: (48.0, 87.0, 68.0, 34.0),
}
EDUCATION_SHARES = {"preescolar": 0.12, "primaria": 0.45, "secundaria": 0.28, "media": 0.15}

# --- Fixed values: sector, source and nationwide row --------------------------------
SECTOR_TOLLS, SOURCE_TOLLS = "transporte", "ANI"
SECTOR_INDEX, SOURCE_INDEX = "agropecuario", "UPRA"
SECTOR_CLIMATE, SOURCE_CLIMATE = "climatico", "IDEAM"
SECTOR_CONNECTIVITY, SOURCE_CONNECTIVITY = "tecnologia", "MinTIC"
SECTOR_EDUCATION, SOURCE_EDUCATION = "educacion", "MEN-SIMAT"
SIMULATED_CONNECTIVITY = "DANE-MinTIC-SIMULADO"
SIMULATED_EDUCATION = "MEN-SIMAT-SIMULADO"
NATIONAL = {"codigo_dane": "00", "departamento": "Nacional", "municipio": "Colombia",
            "latitud": 4.5709, "longitud": -74.2973}

# --- Fixed values: forecast series ---------------------------------------------------
# series -> (title, unit, season length, transform)
FORECAST_SERIES = {
    "upra_indice_total": ("Índice de precios de insumos", "Índice base 100", 12, "log"),
    "ideam_precipitacion_mm": ("Precipitación mensual", "mm/mes", 12, "sqrt"),
    "ideam_temperatura_c": ("Temperatura mensual", "°C", 12, "none"),
}
