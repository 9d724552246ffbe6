"""Word lists and lookup tables that results depend on."""

# --- fixed values: synonyms, term -> canonical form -------------------------
SYNONYMS = {
    # pipes
    "CAÑERIA": "CAÑO", "TUBERIA": "CAÑO", "TUBERÍA": "CAÑO", "TUBO": "CAÑO", "TUBOS": "CAÑOS", "CONDUIT": "CAÑO",
    # ribbed bar
    "HIERRO CONSTRUCCION": "CORRUGADO", "BARRA CORRUGADA": "CORRUGADO", "VARILLA CORRUGADA": "CORRUGADO",
    "REDONDO CORRUGADO": "CORRUGADO", "ALETEADO": "CORRUGADO", "CABILLA": "CORRUGADO", "BARRA HIERRO": "CORRUGADO",
    "ADN": "ALETEADO", "HIERRO ADN": "HIERRO ALETEADO",
    # aggregates
    "ARENA RUBIA": "ARENA", "ARENA FINA": "ARENA", "ARENA GRUESA": "ARENA", "PIEDRA PARTIDA": "PIEDRA",
    # plain bar
    "VARILLA LISA": "REDONDO LISO",
    # sheet and plate
    "PLANCHA": "CHAPA", "LAMINA": "CHAPA", "HIERRO PLANO": "PLANCHUELA",
    # welded mesh
    "MALLA ELECTROSOLDADA": "MALLA SOLDADA", "MALLA ELECTRO SOLDADA": "MALLA SOLDADA", "MALLA SIMA": "MALLA SOLDADA",
    # wire
    "ALAMBRE NEGRO": "ALAMBRE", "ALAMBRE ATAR": "ALAMBRE",
    # steel framing
    "TRACK": "SOLERA", "RUNNER": "SOLERA", "STUD": "MONTANTE", "PARANTE": "MONTANTE",
    # screws
    "AUTOROSCANTE": "AUTOPERFORANTE", "AUTORROSCANTE": "AUTOPERFORANTE", "AUTOPER": "AUTOPERFORANTE",
    # coated metal
    "GALVALUME": "CINCALUM", "GALVACERO": "CINCALUM", "ZINCANNEALED": "GALVANIZADO", "GALVANIZADA": "GALVANIZADO",
    "ANGULAR": "ANGULO", "ÁNGULO": "ANGULO",
    # insulation
    "LANA DE ROCA": "LANA ROCA", "LANA MINERAL": "LANA ROCA", "ROCKWOOL": "LANA ROCA", "LANA DE VIDRIO": "LANA VIDRIO",
    "ISOVER": "LANA VIDRIO", "BARRERA DE VAPOR": "MEMBRANA", "BARRERA VAPOR": "MEMBRANA", "VAPOR BARRIER": "MEMBRANA",
    # boards
    "PLACA DE YESO": "PLACA YESO", "PYG": "PLACA YESO", "PLACA CEMENTICIA": "PLACA CEMENTO", "FIBROCEMENTO": "PLACA CEMENTO",
    "HARDIPANEL": "PLACA CEMENTO", "MADERA RECONSTITUIDA": "OSB",
    # electrical conductors
    "HILO": "CABLE", "CONDUCTOR": "CABLE", "ALAMBRE ELECTRICO": "CABLE",
    # electrical protection
    "BREAKER": "DISYUNTOR", "TERMOMAGNÉTICO": "TERMICA", "TERMOMAGNETICO": "TERMICA", "LLAVE TERMICA": "TERMICA",
    "LLAVE TÉRMICA": "TERMICA", "INTERRUPTOR DIFERENCIAL": "DIFERENCIAL",
    # sockets and switches
    "TOMA CORRIENTE": "TOMA", "TOMACORRIENTE": "TOMA", "ENCHUFE": "TOMA", "INTERRUPTOR": "TECLA", "LLAVE LUZ": "TECLA",
    "SWITCH": "TECLA",
    # lighting
    "BOMBILLA": "LAMPARA", "FOCO": "LAMPARA", "LUMINARIA": "ARTEFACTO", "APLIQUE": "ARTEFACTO",
    # hoses
    "CAÑO CORRUGADO": "MANGUERA CORRUGADA", "FLEXIBLE": "MANGUERA",
    # plumbing pipes
    "POLIETILENO DE ALTA DENSIDAD": "POLIETILENO", "PEAD": "POLIETILENO", "NIPLE": "UNION", "CUPLA": "UNION",
    "ACOPLE": "UNION", "REDUCCIÓN": "REDUCCION", "REDUCCION EXCENTRICA": "REDUCCION", "REDUCCION CONCENTRICA": "REDUCCION",
    # taps and valves
    "VALVULA DE ESFERA": "VALVULA", "VALVULA ESFERA": "VALVULA", "LLAVE DE PASO": "VALVULA", "LLAVE ESFERA": "VALVULA",
    "REGISTRO": "VALVULA", "CANILLA": "GRIFO",
    # masonry
    "PORTLAND": "CEMENTO", "CAL HIDRATADA": "CAL", "ÁRIDO": "ARENA", "ARIDO": "ARENA", "GRAVILLA": "CASCOTE",
    "PEDREGULLO": "CASCOTE", "MORTERO ADHESIVO": "ADHESIVO", "PEGAMENTO": "ADHESIVO", "PEGASOL": "ADHESIVO",
    "JAHARRO": "REVOQUE", "ENDUIDO PLÁSTICO": "MASILLA", "ENDUIDO PLASTICO": "MASILLA", "ENDUIDO": "MASILLA",
    "REVOQUE": "MASILLA",
    # paint
    "ESMALTE SINTÉTICO": "ESMALTE", "ESMALTE SINTETICO": "ESMALTE", "LÁTEX": "LATEX", "TEMPERA": "LATEX",
    "EMULSIÓN": "LATEX", "EMULSION": "LATEX", "IMPRIMACIÓN": "FONDO", "IMPRIMACION": "FONDO", "PRIMER": "FONDO",
    "AGUARRÁS": "AGUARRAS", "AGUARAS": "AGUARRAS", "DILUYENTE": "AGUARRAS", "DISOLVENTE": "AGUARRAS",
    # abbreviations
    "HEX": "HEXAGONAL",
}

# --- fixed values: equivalent brands, one group per row ----------------------
BRAND_GROUPS = (
    ("WADUCT", "DURATOP", "AMANCO", "TIGRE", "PLUSGAS", "LOTIX"),
    ("AWADUCT", "ADURATOP"),
    ("BTICINO", "GEWISS", "TICINO"),
    ("IRAM", "SICA"),
)

# --- fixed values: keywords of the first scorer -------------------------------
KEYWORDS = (
    "MONTANTE", "SOLERA", "PGO", "PGU", "OSB", "LANA", "MEMBRANA", "POLIETILENO", "CHAPA", "BANDA", "CINTA", "TORNILLO",
    "PLACA", "PERFIL", "HEXAGONAL", "AGUJA", "MECHA", "AUTOPERFORANTE", "TEL", "ALAS", "YESO", "CINCALUM", "GALVANIZADA",
    "CABLE", "TOMA", "TECLA", "MODULO", "BASTIDOR", "TAPA", "CAÑO", "DISYUNTOR", "TERMICA", "SPOT", "DICROICO",
    "JABALINA", "PRECINTO", "RELOJ", "BIDIRECCIONAL", "MIGNON", "ESTANCA", "EMBUTIR", "OCTOGONAL", "RECTANGULAR",
    "MANGUERA", "CONECTOR", "UNION", "ARTEFACTO", "CORRUGADO", "ANGULO", "PLANCHUELA", "CUADRADO", "REDONDO", "ALETEADO",
    "SOLDADA", "MALLA", "ZINCANNEALED", "LAF", "SAE",
)
DISTINCTIVE = (
    "MONTANTE", "SOLERA", "PGO", "PGU", "AGUJA", "MECHA", "HEXAGONAL", "CAJA", "CABLE", "TOMA", "TECLA", "MODULO",
    "BASTIDOR", "TAPA", "SPOT", "DISYUNTOR", "TERMICA", "CORRUGADO", "REDONDO", "ANGULO", "PLANCHUELA", "MALLA", "SOLDADA",
    "BLOQUE",
)

# --- fixed values: qualifiers that change the product -------------------------
QUALIFIERS = (
    ("blanco", r"\b(BLANCO|BLANCA|BCO|BCA)\b"),
    ("refractario", r"\bREFRACTARI\w*"),
    ("cementicia", r"\bCEMENTICI\w*"),
    ("doble", r"\bDOBLES?\b"),
)

# --- fixed values: province fragment -> region, first hit wins ----------------
REGIONS = (
    ("caba", "CABA"), ("ciudad autonoma", "CABA"), ("capital federal", "CABA"),
    ("buenos aires", "Buenos Aires"), ("gba", "Buenos Aires"),
    ("cordoba", "Centro"), ("santa fe", "Centro"), ("entre rios", "Centro"),
    ("mendoza", "Cuyo"), ("san juan", "Cuyo"), ("san luis", "Cuyo"),
    ("jujuy", "NOA"), ("salta", "NOA"), ("tucuman", "NOA"), ("catamarca", "NOA"), ("santiago del estero", "NOA"),
    ("la rioja", "NOA"),
    ("misiones", "NEA"), ("corrientes", "NEA"), ("chaco", "NEA"), ("formosa", "NEA"),
    ("neuquen", "Patagonia"), ("rio negro", "Patagonia"), ("chubut", "Patagonia"), ("santa cruz", "Patagonia"),
    ("tierra del fuego", "Patagonia"), ("la pampa", "Patagonia"),
)
NO_REGION = "Otras / sin dato"

# --- fixed values: monthly price and limits per plan ---------------------------
PLAN_PRICES = {"advance": 48000, "pro": 48000, "basico": 19600}

# --- fixed values: header names per sheet field --------------------------------
SHEET_HEADERS = {
    "cod": ("cod", "codigo", "cod prov", "ref", "referencia", "item", "articulo", "art", "sku"),
    "desc": ("descripcion", "detalle", "producto", "material", "denominacion", "descripcion del articulo", "concepto"),
    "cant": ("cant", "cantidad", "cant.", "unidades", "un", "q"),
    "pu": ("precio", "precio unit", "precio unitario", "p unit", "p. unit", "unitario", "precio unit.", "p.unitario", "pu"),
    "total": ("total", "importe", "subtotal", "imp total", "total unif", "importe total"),
}
