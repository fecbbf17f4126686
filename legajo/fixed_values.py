"""Word lists, lookup tables, patterns and constants.

Everything here is data whose exact content decides results; no logic lives in
this module.  Operators fold these tables into literal column expressions, so
none of them is ever shuffled.
"""

# --- fixed values: the 14 fields of a claim --------------------------------
REQUIRED_FIELDS = [
    "numero_siniestro",
    "nombre_asegurado",
    "numero_poliza",
    "vigencia_inicio",
    "vigencia_fin",
    "domicilio_poliza",
    "bien_reclamado",
    "monto_reclamacion",
    "tipo_siniestro",
    "fecha_ocurrencia",
    "fecha_reclamacion",
    "lugar_hechos",
    "ajuste",
    "conclusiones",
]

DATE_FIELDS = ["fecha_ocurrencia", "fecha_reclamacion", "vigencia_inicio", "vigencia_fin"]
AMOUNT_FIELD = "monto_reclamacion"

# --- fixed values: fields of the consolidated case, in report order --------
CONSOLIDATED_FIELDS = [
    "numero_siniestro",
    "nombre_asegurado",
    "monto_reclamacion",
    "numero_poliza",
    "vigencia",
    "domicilio_poliza",
    "tipo_siniestro",
    "fecha_ocurrencia",
    "fecha_reclamacion",
    "lugar_hechos",
    "bien_reclamado",
    "ajuste",
    "conclusiones",
]

# --- fixed values: document type -> fields it may supply -------------------
# A type that is absent supplies every field; a type with an empty list none.
ALLOWED_FIELDS = {
    "informe_preliminar_del_ajustador": [
        "numero_siniestro", "nombre_asegurado", "bien_reclamado", "fecha_ocurrencia",
        "fecha_reclamacion", "lugar_hechos", "ajuste",
    ],
    "informe_final_del_ajustador": [
        "numero_siniestro", "nombre_asegurado", "bien_reclamado", "fecha_ocurrencia",
        "fecha_reclamacion", "lugar_hechos", "ajuste", "conclusiones",
    ],
    "poliza_de_la_aseguradora": [
        "numero_poliza", "vigencia_inicio", "vigencia_fin", "domicilio_poliza",
    ],
    "expediente_de_cobranza": ["numero_poliza", "vigencia_inicio", "vigencia_fin"],
    "checklist_antifraude": [],
    "carta_de_reclamacion_formal_a_la_aseguradora": ["monto_reclamacion"],
    "carta_de_reclamacion_formal_al_transportista": ["monto_reclamacion"],
    "carpeta_de_investigacion": ["tipo_siniestro"],
    "acreditacion_de_propiedad_y_representacion": [],
    "narracion_de_hechos": ["tipo_siniestro"],
    "declaracion_del_asegurado": ["tipo_siniestro"],
    "guias_y_facturas": [],
    "guias_y_facturas_consolidadas": [],
    "salida_de_almacen": [],
    "carta_porte": [],
    "tarjeta_de_circulacion_vehiculo": [],
    "licencia_del_operador": [],
    "aviso_de_siniestro_transportista": ["fecha_ocurrencia", "lugar_hechos"],
    "reporte_gps": [],
    "otro": [],
}

# --- fixed values: labels under which a field is written -------------------
FIELD_SYNONYMS = {
    "numero_siniestro": [
        "Siniestro", "N° de siniestro", "No. de siniestro", "Su Referencia", "Número de siniestro",
    ],
    "nombre_asegurado": [
        "Asegurado", "Contratante", "Cliente", "Nombre del asegurado", "Razón social",
    ],
    "numero_poliza": [
        "Póliza", "Póliza No.", "No. de póliza", "Policy No.", "Número de póliza",
    ],
    "vigencia_inicio": [
        "Vigencia", "Desde", "Vigencia desde", "Fecha inicio", "Inicio de vigencia",
    ],
    "vigencia_fin": [
        "Hasta", "Vigencia hasta", "Fecha fin", "Fin de vigencia", "Vencimiento",
    ],
    "domicilio_poliza": [
        "Domicilio Fiscal", "Dirección Fiscal", "Domicilio", "Dirección del asegurado",
    ],
    "bien_reclamado": [
        "Bienes Afectados", "Bien afectado", "Objeto afectado", "Mercancía afectada", "Bienes",
    ],
    "monto_reclamacion": [
        "Valor estimado", "Total estimado de daños", "Importe total robado", "Monto reclamado",
        "Suma reclamada", "Valor de la reclamación",
    ],
    "tipo_siniestro": [
        "Tipo de siniestro", "Clase de siniestro", "Naturaleza del siniestro", "Evento",
    ],
    "fecha_ocurrencia": [
        "Fecha y hora de ocurrido", "Fecha de siniestro", "Fecha del evento", "Cuando ocurrió",
    ],
    "fecha_reclamacion": [
        "Fecha de reporte", "Fecha y hora reportado", "Fecha de reclamación", "Cuando se reportó",
    ],
    "lugar_hechos": [
        "Ubicación del siniestro", "Lugar del siniestro", "Domicilio del evento", "Donde ocurrió",
    ],
    "ajuste": [
        "Ajustador", "Despacho ajustador", "Empresa ajustadora", "Firma ajustadora",
        "Ajuste realizado por",
    ],
}

# --- fixed values: field rules ---------------------------------------------
FIELD_RULES = {
    "numero_siniestro": {"regex": r"^\d{14}$", "format": "14 dígitos exactos", "digits": 14},
    "nombre_asegurado": {
        "min_length": 3, "max_length": 120, "format": "Nombre completo o razón social",
    },
    "numero_poliza": {
        "regex": r"^[A-Z0-9\-\s]+$", "format": "Alfanumérico con guiones y espacios",
    },
    "vigencia_inicio": {"type": "date", "format": "DD/MM/YYYY"},
    "vigencia_fin": {"type": "date", "format": "DD/MM/YYYY"},
    "bien_reclamado": {"max_words": 5, "format": "Máximo 5 palabras"},
    "monto_reclamacion": {"type": "float", "min": 0, "format": "Número positivo"},
    "fecha_ocurrencia": {"type": "date", "format": "DD/MM/YYYY"},
    "fecha_reclamacion": {"type": "date", "format": "DD/MM/YYYY"},
}

# --- fixed values: loss-type catalogue and keyword map ---------------------
LOSS_TYPES = {
    "automoviles": [
        "Colisión / Choque",
        "Robo Total / Parcial",
        "Daños Materiales",
        "Responsabilidad Civil (Daños a Terceros)",
    ],
    "hogar": ["Incendio", "Inundación", "Robo", "Daños por Fenómeno Natural"],
    "gastos_medicos_vida": [
        "Enfermedad / Accidente (Gastos Médicos)",
        "Fallecimiento (Vida)",
        "Invalidez Total y Permanente (Vida)",
    ],
    "transporte": [
        "Riesgos Ordinarios de Tránsito (ROT)",
        "Robo de Bulto por Entero",
        "Riesgos por Maniobras",
        "Rapiña o Saqueo",
    ],
}
LOSS_KEYWORDS = {
    "colision": "Colisión / Choque",
    "choque": "Colisión / Choque",
    "robo": "Robo Total / Parcial",
    "incendio": "Incendio",
    "inundacion": "Inundación",
    "transito": "Riesgos Ordinarios de Tránsito (ROT)",
}

RECOGNISED_ADJUSTERS = ["SINIESCA", "PARK PERALES"]

# --- fixed values: extraction routes ---------------------------------------
EXTENSION_ROUTES = {
    ".pdf": "auto",
    ".jpg": "direct_ai",
    ".jpeg": "direct_ai",
    ".png": "direct_ai",
    ".tiff": "direct_ai",
    ".docx": "ocr_text",
    ".doc": "ocr_text",
    ".csv": "ocr_text",
}
TYPE_ROUTES = {
    "carta_de_reclamacion_formal_a_la_aseguradora": "ocr_text",
    "carta_de_reclamacion_formal_al_transportista": "ocr_text",
    "guias_y_facturas": "ocr_text",
    "tarjeta_de_circulacion_vehiculo": "ocr_text",
    "licencia_del_operador": "ocr_text",
    "aviso_de_siniestro_transportista": "ocr_text",
    "carpeta_de_investigacion": "ocr_text",
    "acreditacion_de_propiedad_y_representacion": "ocr_text",
    "salida_de_almacen": "ocr_text",
    "reporte_gps": "ocr_text",
    "guias_y_facturas_consolidadas": "ocr_text",
    "expediente_de_cobranza": "ocr_text",
    "checklist_antifraude": "ocr_text",
    "poliza_de_la_aseguradora": "direct_ai",
    "informe_preliminar_del_ajustador": "direct_ai",
    "informe_final_del_ajustador": "direct_ai",
}
ORGANISER_ROUTES = {
    ".pdf": "ocr_text",
    ".jpg": "direct_ai",
    ".jpeg": "direct_ai",
    ".png": "direct_ai",
    ".docx": "ocr_text",
    ".xlsx": "ocr_text",
    ".csv": "ocr_text",
}
ROUTE_LABELS = {"ocr_text": "OCR", "direct_ai": "VIS"}

# --- fixed values: priority profiles (lower number wins, 99 = unknown) ------
PRIORITY_PROFILES = {
    "class": {
        "carpeta_de_investigacion": 1,
        "informe_preliminar_del_ajustador": 2,
        "informe_final_del_ajustador": 3,
        "poliza_de_la_aseguradora": 4,
        "carta_de_reclamacion_formal_a_la_aseguradora": 5,
        "carta_de_reclamacion_formal_al_transportista": 6,
        "acreditacion_de_propiedad_y_representacion": 7,
        "aviso_de_siniestro_transportista": 8,
        "guias_y_facturas": 9,
        "guias_y_facturas_consolidadas": 10,
        "tarjeta_de_circulacion_vehiculo": 11,
        "licencia_del_operador": 12,
        "salida_de_almacen": 13,
        "reporte_gps": 14,
        "expediente_de_cobranza": 15,
        "checklist_antifraude": 16,
        "otro": 99,
    },
    "field": {
        "informe_preliminar_del_ajustador": 1,
        "poliza_de_la_aseguradora": 2,
        "carta_de_reclamacion_formal_a_la_aseguradra": 3,
        "carta_de_reclamacion_formal_a_la_aseguradora": 3,
        "carpeta_de_investigacion": 4,
        "narracion_de_hechos": 4,
        "declaracion_del_asegurado": 4,
        "poliza": 2,
        "poliza_seguro": 2,
        "denuncia": 5,
        "factura": 6,
        "factura_compra": 6,
        "peritaje": 7,
        "carta_porte": 8,
        "otro": 99,
    },
    "module": {
        "carpeta_de_investigacion": 1,
        "poliza_de_la_aseguradora": 2,
        "guias_y_facturas": 3,
        "informe_preliminar_del_ajustador": 4,
        "informe_final_del_ajustador": 5,
        "carta_de_reclamacion_formal_a_la_aseguradora": 6,
        "carta_de_reclamacion_formal_al_transportista": 7,
        "acreditacion_de_propiedad_y_representacion": 8,
        "reporte_gps": 9,
        "aviso_de_siniestro_transportista": 10,
        "guias_y_facturas_consolidadas": 11,
        "tarjeta_de_circulacion_vehiculo": 12,
        "licencia_del_operador": 13,
        "salida_de_almacen": 14,
        "expediente_de_cobranza": 15,
        "checklist_antifraude": 16,
        "otro": 99,
    },
}

# --- fixed values: per-field priority of types (profile "yaml") -------------
FIELD_TYPE_PRIORITIES = {
    "numero_poliza": ["poliza", "poliza_seguro", "carta_reclamacion"],
    "nombre_asegurado": ["poliza", "poliza_seguro", "denuncia"],
    "vigencia_inicio": ["poliza", "poliza_seguro"],
    "vigencia_fin": ["poliza", "poliza_seguro"],
    "domicilio_poliza": ["poliza", "poliza_seguro"],
    "fecha_ocurrencia": ["denuncia", "peritaje", "carta_porte"],
    "lugar_hechos": ["denuncia", "bitacora_gps"],
    "monto_reclamacion": ["factura", "factura_compra", "peritaje"],
    "bien_reclamado": ["factura", "factura_compra", "carta_porte"],
}

# --- fixed values: source-name rules used when no priority is known ---------
FIELD_SOURCE_RULES = {
    "numero_siniestro": ["denuncia", "poliza"],
    "nombre_asegurado": ["poliza", "denuncia"],
    "numero_poliza": ["poliza", "denuncia"],
    "vigencia_inicio": ["poliza"],
    "vigencia_fin": ["poliza"],
    "domicilio_poliza": ["poliza", "denuncia"],
    "bien_reclamado": ["denuncia", "factura"],
    "monto_reclamacion": ["denuncia", "factura", "peritaje"],
    "tipo_siniestro": ["denuncia", "poliza"],
    "fecha_ocurrencia": ["denuncia", "peritaje"],
    "fecha_reclamacion": ["denuncia"],
    "lugar_hechos": ["denuncia", "peritaje"],
    "ajuste": ["peritaje"],
    "conclusiones": ["peritaje", "denuncia"],
}

# --- fixed values: short names of document types ----------------------------
SHORT_TYPE_ALIASES = {
    "poliza": "poliza_de_la_aseguradora",
    "informe_preliminar": "informe_preliminar_del_ajustador",
    "informe_final": "informe_final_del_ajustador",
    "reclamacion_aseg": "carta_de_reclamacion_formal_a_la_aseguradora",
    "reclamacion_trans": "carta_de_reclamacion_formal_al_transportista",
    "investigacion": "carpeta_de_investigacion",
    "acreditacion": "acreditacion_de_propiedad_y_representacion",
    "guias_facturas": "guias_y_facturas",
    "guias_consolidadas": "guias_y_facturas_consolidadas",
    "salida_almacen": "salida_de_almacen",
    "tarjeta_circ": "tarjeta_de_circulacion_vehiculo",
    "licencia": "licencia_del_operador",
    "aviso_siniestro": "aviso_de_siniestro_transportista",
    "gps": "reporte_gps",
    "cobranza": "expediente_de_cobranza",
    "antifraude": "checklist_antifraude",
}
FILE_TYPE_ALIASES = {
    "DENUNCIA": "denuncia_inicial",
    "FACTURA": "guias_y_facturas",
    "GUIA": "guias_y_facturas",
    "POLIZA": "poliza_de_la_aseguradora",
    "REPORTE": "reporte_gps",
    "LICENCIA": "licencia_del_operador",
    "TARJETA": "tarjeta_de_circulacion_vehiculo",
    "RECLAMACION": "carta_de_reclamacion_formal_a_la_aseguradora",
    "CHECKLIST": "checklist_antifraude",
    "OTROS": "otro",
}

# --- fixed values: classifier lexicon ---------------------------------------
# (type, keywords, must_have, may_have, exclude, description), in tie-break order
CLASSIFIER_LEXICON = [
    ("carta_de_reclamacion_formal_a_la_aseguradora",
     ["carta reclamación", "aviso de siniestro", "solicitud de indemnización",
      "reclamación formal", "reembolso"],
     ["aseguradora"],
     ["siniestro", "póliza", "facturas", "mercancía", "importes", "firma"],
     ["transportista", "guía de embarque exclusivamente"],
     "Carta formal a la aseguradora solicitando indemnización"),
    ("carta_de_reclamacion_formal_al_transportista",
     ["carta reclamación", "reclamacion_transportista", "reclamación transportista",
      "mercancía no entregada", "incumplimiento"],
     [],
     ["guías", "facturas", "importes", "explicación", "causas"],
     ["aseguradora", "indemnización del seguro"],
     "Carta al transportista reclamando por mercancía no entregada"),
    ("guias_y_facturas",
     ["número de guía", "factura", "guia_embarque", "guía embarque", "guía de embarque", "cfdi",
      "refacciones", "código sat", "total"],
     [],
     ["peso", "remitente", "destinatario", "subtotal", "iva", "total", "pagare"],
     ["consolidado", "múltiples clientes en un archivo"],
     "Guías de transporte con facturas comerciales"),
    ("guias_y_facturas_consolidadas",
     ["consolidado", "múltiples guías", "varios clientes"],
     ["consolidado"],
     ["etiquetas", "paquetería", "cfdi", "pagares"],
     [],
     "Múltiples guías y facturas en un solo archivo consolidado"),
    ("tarjeta_de_circulacion_vehiculo",
     ["tarjeta de circulación", "tarjeta_circulacion", "tarjeta circulación",
      "tipo de transporte", "niv", "placas"],
     [],
     ["folio", "marca", "modelo", "año", "propietario", "estado emisor"],
     ["licencia", "operador", "fotografía"],
     "Documento oficial de circulación vehicular"),
    ("licencia_del_operador",
     ["licencia", "operador", "chofer", "conductor"],
     ["licencia"],
     ["fotografía", "curp", "tipo de licencia", "vigencia", "firma", "huella"],
     ["tarjeta de circulación", "vehículo", "placas"],
     "Licencia oficial del conductor/operador"),
    ("aviso_de_siniestro_transportista",
     ["ficha", "aviso de siniestro", "aviso_siniestro", "aviso siniestro", "reporte siniestro",
      "transportista"],
     [],
     ["fecha", "hora", "lugar", "operador", "unidad", "accidente", "asalto", "robo"],
     ["fiscalía", "ministerio público", "ajustador"],
     "Reporte de siniestro emitido por la transportista"),
    ("carpeta_de_investigacion",
     ["carpeta de investigación", "carpeta_investigacion", "carpeta investigación", "fgr",
      "fiscalía", "ministerio público", "querella"],
     [],
     ["investigación", "folio", "acuerdos", "denunciante", "ofendidos", "hechos", "acta"],
     [],
     "Documento oficial de investigación judicial"),
    ("acreditacion_de_propiedad_y_representacion",
     ["acreditación", "propiedad", "representación legal", "poder notarial"],
     ["acreditación"],
     ["poderes", "identificaciones", "constancias", "facturas", "guías"],
     [],
     "Documentos que acreditan propiedad y representación legal"),
    ("salida_de_almacen",
     ["salida de almacén", "salida_almacen", "salida almacén", "embarque", "control interno"],
     [],
     ["códigos", "piezas", "cantidades", "firmas", "responsable", "transportista"],
     ["cfdi", "factura", "guía de paquetería"],
     "Control interno de salida de mercancías del almacén"),
    ("reporte_gps",
     ["rastreo satelital", "gps", "reporte gps", "coordenadas", "recorrido", "telemetría"],
     ["gps"],
     ["periodo", "distancia", "velocidad", "combustible", "horarios", "direcciones"],
     [],
     "Informe de rastreo satelital del vehículo"),
    ("poliza_de_la_aseguradora",
     ["póliza", "poliza_seguro", "póliza seguro", "póliza de seguro", "cobertura", "vigencia",
      "asegurado", "prima", "transporte marítimo"],
     [],
     ["carátula", "límites", "deducibles", "cláusulas", "endosos", "exclusiones"],
     ["reclamación", "siniestro ocurrido"],
     "Contrato formal de seguro"),
    ("informe_preliminar_del_ajustador",
     ["informe preliminar", "informe_ajustador", "informe ajustador", "ajustador",
      "estimación inicial"],
     [],
     ["asegurado", "póliza", "evento", "pérdida", "deducible", "observaciones"],
     ["final", "definitivo", "conclusión"],
     "Valoración inicial del ajustador"),
    ("informe_final_del_ajustador",
     ["informe final", "ajustador", "recomendación", "indemnización"],
     ["final", "ajustador"],
     ["narrativa", "análisis", "cotejo", "salvamento", "subrogación"],
     ["preliminar", "inicial"],
     "Conclusión definitiva del ajustador"),
    ("expediente_de_cobranza",
     ["cobranza", "recibos pagados", "validez cobertura"],
     ["cobranza"],
     ["comunicaciones", "pantallas", "comprobantes", "pago", "vigente"],
     [],
     "Validación del estado de cobranza de la póliza"),
    ("checklist_antifraude",
     ["checklist", "antifraude", "checklist antifraude", "evaluación", "evaluación de riesgo",
      "parámetros alerta", "validación"],
     ["antifraude"],
     ["crítico", "no crítico", "analista", "firmas", "riesgos"],
     [],
     "Formato de evaluación de riesgo de fraude"),
]

# --- fixed values: simple detectors ------------------------------------------
COUNTING_DETECTOR = {
    "poliza": ["póliza", "poliza", "cobertura", "vigencia", "prima", "asegurado"],
    "factura": ["factura", "cfdi", "subtotal", "iva", "total"],
    "denuncia": ["denuncia", "ministerio", "querella", "declaración", "declaracion"],
    "peritaje": ["peritaje", "dictamen", "evaluación", "evaluacion", "daños", "danos"],
    "carta_porte": ["carta porte", "transportista", "remitente", "destinatario"],
}
FIRST_HIT_DETECTOR = {
    "carta_reclamacion": ["reclamacion", "reclamación", "reclamo"],
    "carta_respuesta": ["respuesta", "contestación"],
    "carpeta_investigacion": ["carpeta", "investigacion", "investigación", "ministerio"],
    "tarjeta_circulacion": ["circulacion", "circulación", "vehicular"],
    "factura_compra": ["factura", "cfdi", "comprobante fiscal"],
    "bitacora_viaje": ["bitacora", "bitácora", "viaje"],
    "reporte_gps": ["gps", "telemetria", "telemetría", "rastreo"],
    "denuncia": ["denuncia", "querella"],
    "carta_porte": ["carta porte", "complemento carta porte"],
    "validacion_mp": ["validacion", "validación", "ministerio publico"],
    "consulta_repuve": ["repuve", "registro vehicular"],
    "candados_seguridad": ["candados", "seguridad", "sellos"],
    "peritaje": ["peritaje", "dictamen", "pericial"],
}
NAME_DETECTOR = {
    "factura": ["factura", "invoice"],
    "poliza": ["poliza", "policy"],
    "denuncia": ["denuncia"],
    "carta_reclamacion": ["carta"],
}

# --- fixed values: recipient patterns, tried in order -------------------------
RECIPIENT_PATTERNS = [
    r"Destinatario:?\s*([^\n]+)",
    r"Cliente:?\s*([^\n]+)",
    r"Consignado a:?\s*([^\n]+)",
    r"Nombre:?\s*([^\n]+)",
    r"Razón Social:?\s*([^\n]+)",
]
ORGANISER_RECIPIENT_PATTERNS = [
    r"Destinatario:?\s*([^\n]+)",
    r"Cliente:?\s*([^\n]+)",
    r"Consignado a:?\s*([^\n]+)",
    r"Nombre del Cliente:?\s*([^\n]+)",
    r"Razón Social:?\s*([^\n]+)",
]

# --- fixed values: last-resort field patterns (field, pattern, strip, confidence)
EMERGENCY_PATTERNS = [
    ("numero_poliza", r"[Pp][óo]liza.*?([A-Z0-9\-]{5,})", "", 0.3),
    ("nombre_asegurado", r"[Nn]ombre:?\s*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s,\.]+)", " ,.", 0.2),
    ("monto_reclamacion", r"\$\s*([\d\.,]+)", "", 0.2),
]

# --- fixed values: terms that mark a relevant line ----------------------------
RELEVANT_LINE_TERMS = [
    "póliza", "poliza", "asegurado", "vigencia", "siniestro", "monto", "fecha", "reclamación",
    "reclamacion", "cobertura",
]

NULL_TOKENS = ["", "null", "None", "N/A", "NO ESPECIFICADO"]

# --- fixed values: Spanish month abbreviations ---------------------------------
MONTHS = {
    "ENE": "01", "FEB": "02", "MAR": "03", "ABR": "04", "MAY": "05", "JUN": "06",
    "JUL": "07", "AGO": "08", "SEP": "09", "OCT": "10", "NOV": "11", "DIC": "12",
}

# --- fixed values: OCR model choice by file name --------------------------------
OCR_MODELS = {
    "prebuilt-invoice": ["cfdi", "factura_sat"],
    "prebuilt-idDocument": ["ine", "ife", "pasaporte"],
}
DEFAULT_OCR_MODEL = "prebuilt-document"
MAX_OCR_BYTES = 50 * 1024 * 1024

# --- fixed values: language-model choice per (task, route) ----------------------
TASK_MODELS = {
    ("extraction", "direct_ai"): "gpt-5-mini",
    ("extraction", "ocr_text"): "gpt-5",
    ("consolidation", "*"): "gpt-5",
    ("generation", "*"): "gpt-5-mini",
}
DEFAULT_TASK_MODEL = "gpt-4o-mini"

# --- fixed values: supported extensions ------------------------------------------
SUPPORTED_EXTENSIONS = {
    "organiser": [".pdf", ".jpg", ".jpeg", ".png", ".docx", ".xlsx", ".csv"],
    "parser": [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".docx", ".xlsx", ".csv"],
    "upload": [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".txt"],
}

# --- fixed values: progress stages, default seconds, smoothing factor -------------
STAGES = ["upload", "ocr", "extract", "consolidate", "analyze", "report"]
STAGE_SECONDS = {
    "upload": 2, "ocr": 15, "extract": 10, "consolidate": 5, "analyze": 8, "report": 5,
}
SMOOTHING = 0.25

# --- fixed values: report labels of the feedback form ------------------------------
FEEDBACK_LABELS = {
    "NÚMERO DE SINIESTRO": "numero_siniestro",
    "NOMBRE DEL ASEGURADO": "nombre_asegurado",
    "MONTO DE RECLAMACIÓN": "monto_reclamacion",
    "NÚMERO DE PÓLIZA": "numero_poliza",
    "VIGENCIA": "vigencia",
    "DOMICILIO DE LA PÓLIZA": "domicilio_poliza",
    "TIPO DE SINIESTRO": "tipo_siniestro",
    "FECHA DE OCURRENCIA": "fecha_ocurrencia",
    "FECHA DE RECLAMACIÓN": "fecha_reclamacion",
    "LUGAR DE LOS HECHOS": "lugar_hechos",
    "BIEN RECLAMADO": "bien_reclamado",
    "AJUSTE": "ajuste",
}
FEEDBACK_STATUSES = ["confirmed", "corrected"]
CASE_STATUSES = ["new", "processing", "ready", "archived"]

# --- fixed values: messages that are part of results --------------------------------
NOT_SPECIFIED = "NO ESPECIFICADO"
NO_NAME = "SIN_NOMBRE"
UNKNOWN_FOLDER = "DESCONOCIDO"
NO_TYPE_REASON = "No se encontraron indicadores claros"
UNKNOWN_TYPE_REASON = "Tipo no reconocido, clasificado como 'otro'"
