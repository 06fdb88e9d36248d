"""The words, tables, patterns and messages that results are made of."""

# --- fixed values: geography --------------------------------------------------------------------
COUNTRY_OF_TLD = {
    "es": "ES", "mx": "MX", "co": "CO", "ar": "AR", "pe": "PE", "cl": "CL", "ec": "EC", "ve": "VE",
    "gt": "GT", "bo": "BO", "py": "PY", "uy": "UY", "cr": "CR", "pa": "PA", "hn": "HN", "sv": "SV",
    "ni": "NI", "do": "DO", "pr": "PR", "cu": "CU", "us": "US", "br": "BR", "pt": "PT",
}
REGION_ORDER = ("MX", "CO", "ES", "AR", "PE", "CL", "EC", "US")
RECOGNIZED_CHARS = 20_000
BARE_CITY_POPULATION, BARE_CITY_LETTERS = 200_000, 5
CITY_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['.][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
CITY_NAME = r"^[A-Za-zÀ-ÖØ-öø-ÿ' .-]+$"
ADDRESS_LABEL = r"(?:direcci[oó]n|ubicaci[oó]n|ubicados?\s+en|nos\s+encontramos\s+en|sucursal(?:es)?\s+en|oficinas?\s+en)\s*[:\-]?\s*([^\n]{5,120})"

# --- fixed values: links ------------------------------------------------------------------------
CONTACT_WORDS = (
    "contactenos", "contactanos", "contáctanos", "contáctenos", "contact us", "contact-us", "contact_us",
    "contacto", "contact", "escribenos", "escríbenos", "escribanos", "atencion al cliente",
    "atención al cliente", "ponte en contacto", "hablemos",
)
TEAM_WORDS = (
    "sobre nosotros", "quienes somos", "quiénes somos", "nuestro equipo", "conoce a nuestro equipo",
    "conoce al equipo", "conoce nuestro equipo", "nuestros profesionales", "nuestros especialistas",
    "equipo médico", "equipo medico", "nosotros", "equipo", "about us", "about-us", "who we are",
    "our team", "meet the team", "team",
)
CONTACT_PATHS = (
    "/contacto", "/contacto.html", "/contactenos", "/contactanos", "/contact", "/contact-us",
    "/contact.html", "/es/contacto", "/pages/contacto", "/nosotros/contacto",
)
TEAM_PATHS = (
    "/nosotros", "/sobre-nosotros", "/quienes-somos", "/equipo", "/nuestro-equipo", "/about", "/about-us",
    "/team", "/es/about-us", "/es/nosotros", "/nosotros/equipo",
)
TEXT_POINTS, HREF_POINTS, CONTACT_LINKS, TEAM_LINKS, MAX_PAGES = 3, 2, 2, 1, 4
URL_HEADERS = ("url", "urls", "website", "web", "sitio", "sitio web", "pagina", "página", "dominio", "link", "enlace")

# --- fixed values: schema.org -------------------------------------------------------------------
BUSINESS_TYPES = (
    "localbusiness", "organization", "corporation", "store", "restaurant", "professionalservice",
    "medicalbusiness", "attorney", "dentist", "generalcontractor", "homeandconstructionbusiness",
    "realestateagent",
)
PEOPLE_KEYS = ("employee", "founder", "founders", "employees")
DAYS = {
    "mo": "Lunes", "monday": "Lunes", "tu": "Martes", "tuesday": "Martes", "we": "Miércoles",
    "wednesday": "Miércoles", "th": "Jueves", "thursday": "Jueves", "fr": "Viernes", "friday": "Viernes",
    "sa": "Sábado", "saturday": "Sábado", "su": "Domingo", "sunday": "Domingo",
}
COMPACT_HOURS = r"\b(Mo|Tu|We|Th|Fr|Sa|Su)(?:-(Mo|Tu|We|Th|Fr|Sa|Su))?\s+(\d{1,2}:\d{2})-(\d{1,2}:\d{2})"
META_CITY = r"geo.placename$"
ITEMPROPS = ("addressLocality", "addressRegion", "addressCountry", "telephone")

# --- fixed values: hours in text ----------------------------------------------------------------
DAY_WORDS = (
    r"lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bados?|domingos?|lun\.?|mar\.?|mi[eé]\.?|jue\.?|vie\.?|s[aá]b\.?|dom\.?"
    r"|todos los d[ií]as|diariamente|d[ií]as h[aá]biles"
)
CLOCK = r"\d{1,2}(?::\d{2})?\s?(?:h(?:rs?|oras?)?(?!\w)\.?|[ap]\.?\s?m\.?)?"
UNTIL = r"(?:a|hasta|-|–|—)"
CLOCK_RANGE = rf"{CLOCK}\s*{UNTIL}\s*{CLOCK}"
HOURS_LINE = rf"(?:{DAY_WORDS})(?:\s*(?:,|y|{UNTIL})\s*(?:{DAY_WORDS}))*[^.;\n]{{0,25}}?({CLOCK_RANGE})"
HOURS_KEYWORD = r"horarios?(?:\s+de\s+atenci[oó]n)?|atendemos|horas?\s+de\s+atenci[oó]n"
HOURS_BEFORE, HOURS_AFTER, HOURS_KEPT = 10, 150, 5
OUTER_MARKS = " .,;:-–—"

# --- fixed values: people -----------------------------------------------------------------------
NAME_WORD = r"[A-ZÁÉÍÓÚÑ](?:[A-ZÁÉÍÓÚÑ]{2,}|[a-záéíóúñ]{2,})"
NAME_LINK = r"(?:de(?:[ \t]+la|[ \t]+los|[ \t]+las)?|del)"
NAME = rf"{NAME_WORD}(?:[ \t]+(?:{NAME_LINK}[ \t]+)?{NAME_WORD}){{1,3}}"
NO_COMPANY = (
    r"\b(?![ \t]*[,.]?[ \t]*(?:S\.?\s?A\.?\s?S?\.?|S\.?\s?L\.?|S\.?\s?R\.?\s?L\.?|Ltda\.?|C\.?\s?A\.?|Inc\.?|LLC"
    r"|E\.?I\.?R\.?L\.?|SAC|SRL)\b)"
)
TITLES = r"(?:Sr|Sra|Srta|Lic|Ing|Dr|Dra|Mtro|Mtra)\.?"
TITLED = rf"\b{TITLES}[ \t]+({NAME}){NO_COMPANY}"
LABELLED = (
    r"(?:Contacto|Atenci[oó]n|Atiende|Responsable|Encargad[oa]|Gerente|Propietari[oa]|Representante|Asesor(?:a)?)"
    rf"\s*:\s*({NAME}){NO_COMPANY}"
)
BARE_LINE = rf"^[ \t]*({NAME}){NO_COMPANY}[ \t]*$"
NOT_NAMES = (
    "todos los derechos", "politica de privacidad", "terminos y condiciones", "aviso de privacidad",
    "atencion al cliente", "servicio al cliente", "lunes a viernes", "horario de atencion",
)
COMPANY_END = r"\b(s\.?a\.?s?\.?|s\.?l\.?|s\.?r\.?l\.?|ltda\.?|c\.?a\.?|inc\.?|llc)\b\.?$"
NAME_RUN = r"^[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'.\- ]*"
NOT_ROLES = (
    "ver perfil", "ver mas", "ver más", "leer mas", "leer más", "leer bio", "video", "compartir", "conocelo",
    "conócelo", "conocela", "conócela", "conoce mas", "conoce más", "saber mas", "saber más", "mas informacion",
    "más información", "+ info", "info", "envelope", "facebook", "instagram", "linkedin", "twitter", "whatsapp",
    "youtube", "tiktok", "pinterest", "book", "treatments", "previous slide", "next slide", "legal notice",
    "read more", "learn more", "see more", "share", "menu", "close",
)
ROLE_SHAPE = r"^[A-Za-zÁÉÍÓÚÑáéíóúñÀ-ÖØ-öø-ÿ0-9 ,.\-&/]{3,60}$"
ROLE_WORDS = (
    "ceo", "cto", "cfo", "coo", "vp", "fundador", "fundadora", "director", "directora", "gerente", "gerenta",
    "coordinador", "coordinadora", "encargado", "encargada", "responsable", "digital", "marketing", "trafficker",
    "atencion", "atención", "cliente", "clientes", "paciente", "pacientes", "especialista", "asesor", "asesora",
    "consultor", "consultora", "comercial", "ventas", "recepcion", "recepción", "administrador", "administradora",
    "socio", "socia",
)
COMPANY_WORDS = (
    "distribuidora", "distribuidor", "comercializadora", "constructora", "inversiones", "corporacion",
    "corporación", "compania", "compañía", "industrias", "importadora", "exportadora", "franquicia", "franquicias",
)
HEADING_WORDS = (
    "nuestra", "nuestro", "nuestros", "nuestras", "filosofia", "filosofía", "historia", "vision", "visión",
    "mision", "misión", "enfoque", "valores", "equipo", "somos", "nosotros",
)
CALL_WORDS = (
    "escribenos", "escríbenos", "escribinos", "llamanos", "llámanos", "contactanos", "contáctanos", "visitanos",
    "visítanos", "siguenos", "síguenos", "suscribete", "suscríbete", "registrate", "regístrate", "solicita",
    "agenda", "reserva", "compra", "compre", "descubre", "explora", "comparte", "consulta", "escribe", "llama",
    "contacta",
)

# --- fixed values: messages ---------------------------------------------------------------------
W_WWW = "{url} no respondió ({error}); se usó {other}"
W_HOME = "no se pudo obtener la página principal ({url}): {error}"
W_PAGE = "no se pudo obtener {url}: {error}"
W_GUESS = "no se encontró un enlace de contacto en la página principal; probando rutas comunes"
W_NO_CONTACT = "no se encontró una página de contacto dedicada; se usó solo la página principal"
W_NO_TEAM = "no se encontró una página de equipo/sobre nosotros (los nombres solo pueden salir de las páginas ya visitadas)"
W_NO_PHONE = "no se encontró ningún número de teléfono"
W_NO_HOURS = "no se encontró un horario de atención"
W_NO_NAMES = "no se encontraron nombres de personas (es común: muchas páginas solo listan datos de la empresa)"
W_NO_CITY = "no se pudo determinar una ciudad probable"
W_BAD_URL = "URL inválida: {error}"
E_EMPTY_URL, E_BAD_URL = "empty URL", "invalid URL: "
CHAT_LINK = r"(?i)(?:wa\.me/|whatsapp\.com/send\?phone=)(\d[\d\s\-]{5,})"
#: Labels of the text block, and what stands for a missing value.
LABELS = {
    "source_url": ("URL:              ", None),
    "contact_page_url": ("Página de contacto: ", "(no encontrada; se usó la página principal)"),
    "team_page_url": ("Página de equipo: ", "(no encontrada)"),
    "names": ("Nombres:          ", "(ninguno encontrado)"),
    "phones": ("Teléfonos:        ", "(ninguno encontrado)"),
    "hours": ("Horario:          ", "(no encontrado)"),
    "city": ("Ciudad probable:  ", "(no determinada)"),
    "country": ("País:             ", None),
    "address_raw": ("Dirección (texto): ", None),
    "warnings": ("Avisos:", None),
}
WARNING_MARK = "\n  - "
CSV_COLUMNS = ("source_url", "contact_page_url", "team_page_url", "names", "phones", "hours", "city", "country", "address_raw", "warnings")
