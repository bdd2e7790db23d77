"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced (category names, type maps, deny-lists, label tables, patterns,
scores, thresholds).  They are stated plainly, in natural order, and turned
into small broadcast dimension tables or literal maps by ``dims.py``.
"""

# --------------------------------------------------------------------------
# FIXED VALUES: entity categories (closed set of six)
# --------------------------------------------------------------------------
CATEGORIES = [
    "persone_fisiche",
    "persone_giuridiche",
    "dati_contatto",
    "identificativi",
    "dati_finanziari",
    "dati_temporali",
]

# --------------------------------------------------------------------------
# FIXED VALUES: detector type -> (category, entity_type)
# --------------------------------------------------------------------------
DETECTOR_TYPE_MAP = [
    ("PERSON", "persone_fisiche", "nome_cognome"),
    ("ORGANIZATION", "persone_giuridiche", "nome_azienda"),
    ("IT_PARTITA_IVA", "identificativi", "partita_iva"),
    ("EMAIL_ADDRESS", "dati_contatto", "email"),
    ("PHONE_NUMBER", "dati_contatto", "telefono"),
    ("IBAN_CODE", "dati_finanziari", "iban"),
    ("CREDIT_CARD", "dati_finanziari", "numero_carta"),
    ("LOCATION", "dati_contatto", "indirizzo"),
    ("DATE_TIME", "dati_temporali", "data_evento"),
    ("NRP", "identificativi", "codice_fiscale"),
    ("IP_ADDRESS", "dati_contatto", "ip_address"),
    ("URL", "dati_contatto", "url"),
    ("MEDICAL_LICENSE", "identificativi", "licenza_medica"),
    ("CRYPTO", "dati_finanziari", "crypto_wallet"),
    ("IT_LICENSE_PLATE", "identificativi", "targa"),
    ("IT_IDENTITY_CARD", "identificativi", "carta_identita"),
    ("IT_IDENTITY_CARD_ELECTRONIC", "identificativi", "carta_identita"),
    ("CH_AVS_NUMBER", "identificativi", "numero_avs"),
]

# Detector types that are statistical (go through the false-positive filter).
SEMANTIC_DETECTOR_TYPES = ["PERSON", "LOCATION", "ORGANIZATION"]

# Entity types that need model confirmation in the merge.
SEMANTIC_MERGE_TYPES = ["nome_cognome", "nome_azienda", "nome_organizzazione", "indirizzo"]

# --------------------------------------------------------------------------
# FIXED VALUES: deny-list of labels and common words, per language
# --------------------------------------------------------------------------
DENY_LIST = {
    "common": [
        "agile", "scrum", "lean", "kanban", "pmp",
        "wms", "pmo", "iban",
        "curriculum vitae",
    ],
    "it": [
        "nome", "cognome", "indirizzo", "telefono", "email", "sede", "iban",
        "documento", "linkedin", "formazione", "standardizzazione", "supporto",
        "riferimenti", "codice fiscale", "profilo",
        "competenze", "esperienza", "disponibili", "certificazioni", "contatti",
        "dati personali",
        "locatore", "conduttore", "conduttrice", "firme", "firma",
        "durata", "canone", "deposito", "causale", "verbale", "clausole",
        "preavviso", "parti", "fornitore", "cliente", "sede legale",
        "paziente", "ricovero", "anamnesi", "diagnosi", "farmaci", "terapia",
        "tessera sanitaria", "cartella clinica", "allergie",
        "amo", "pianificare", "ridurre",
        "implementazione", "creazione", "migrazione",
    ],
    "de": [
        "persönliche daten", "geburtsdatum", "geburtsort", "telefon", "adresse",
        "steuernummer", "kompetenzen", "publikationen", "standort", "ausweisdokument",
        "profil", "erfahrung", "ausbildung", "fähigkeiten", "referenzen",
        "arbeitgeber", "abteilung", "firmenname",
    ],
    "fr": [
        "nom et prénom", "adresse", "téléphone", "code fiscal", "lieu",
        "pour", "analyste", "compétences", "formation", "expérience",
        "références", "employeur", "société", "département",
    ],
    "en": [
        "name", "address", "phone", "skills", "education",
        "references", "employer", "company", "department",
        "date of birth", "place of birth", "nationality",
    ],
}

# Languages that have a detector rule profile; others fall back to the default.
DETECTOR_LANGUAGES = ["it", "en", "fr", "de"]
DEFAULT_LANGUAGE = "it"

# --------------------------------------------------------------------------
# FIXED VALUES: patterns (Java regex; Python-equivalent semantics)
# --------------------------------------------------------------------------
PARTIAL_IBAN_PATTERN = r"^[A-Z]{2}\d{2}[\sA-Z0-9]*$"
IBAN_MIN_LEN_NO_SPACES = 15
SPECIFIC_DATE_PATTERN = r"\d{2,4}[/\-.]\d{2}"
FISCAL_CODE_PATTERN = r"(?i)^[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]$"

# Custom recognisers: (detector type, pattern, base score, context words)
CUSTOM_RECOGNIZERS = [
    ("IT_LICENSE_PLATE", r"\b[A-Z]{2}\d{3}[A-Z]{2}\b", 0.5,
     ["targa", "veicolo", "auto", "autovettura"]),
    ("IT_IDENTITY_CARD", r"\b[A-Z]{2}\d{7}\b", 0.65,
     ["CI", "carta identità", "carta d'identità", "documento identità",
      "carta di identità", "ril.", "rilasciata", "rilasciato"]),
    ("IT_IDENTITY_CARD_ELECTRONIC", r"\b[A-Z]{2}\d{5}[A-Z]{2}\b", 0.65,
     ["CIE", "CI", "carta identità", "carta d'identità", "documento identità",
      "carta di identità", "ril.", "rilasciata", "rilasciato"]),
    ("CH_AVS_NUMBER", r"\b756\.\d{4}\.\d{4}\.\d{2}\b", 0.85,
     ["avs", "ahv", "assicurazione", "previdenza"]),
    ("IT_PARTITA_IVA", r"\b\d{11}\b", 0.4,
     ["P.IVA", "P. IVA", "p.iva", "partita iva", "Partita IVA", "VAT", "codice IVA"]),
]
CONTEXT_BOOST = 0.35

# Corporate suffixes (case-insensitive) that mark a legal entity.
CORPORATE_SUFFIXES = [
    r"S\.?r\.?l\.?s?\.?",
    r"S\.?p\.?A\.?",
    r"S\.?a\.?s\.?",
    r"S\.?n\.?c\.?",
    r"S\.?c\.?r\.?l\.?",
    r"S\.?c\.?a\.?",
    r"S\.?c\.?p\.?a\.?",
    r"S\.?A\.?",
    r"Sagl",
    r"GmbH",
    r"AG",
    r"Ltd\.?",
    r"Inc\.?",
    r"Corp\.?",
    r"LLC",
    r"PLC",
]

# Phrases that mark a nearby value as a legal entity (within 200 characters).
LEGAL_CONTEXT_PHRASES = [
    "sede legale", "ragione sociale", "denominazione sociale",
    "registro imprese", "camera di commercio", "REA",
    "capitale sociale", "legale rappresentante",
    "P.IVA", "partita iva",
]
LEGAL_CONTEXT_WINDOW = 200

# Institution names, one alternative per line.
INSTITUTION_ALTERNATIVES = [
    r"(?:Politecnico|Universit[àa])\s+(?:di|degli|delle|del)\s+\w+",
    r"University\s+of\s+\w+",
    r"\w+\s+University",
    r"Universit[ée]\s+(?:de|d'|du)\s+\w+",
    r"(?:Technische\s+)?Universit[äa]t\s+\w+",
    r"(?:Fach)?[Hh]ochschule\s+\w+",
]
# Each of the alternatives contains one of these.
INSTITUTION_WORDS = ["Universit", "Politecnico", "ochschule"]
INSTITUTION_CONFIDENCE = 0.9

# --------------------------------------------------------------------------
# FIXED VALUES: model-output parsing
# --------------------------------------------------------------------------
TYPE_ALIASES = [
    ("targa_auto", "targa"),
    ("documento_identità", "carta_identita"),
    ("documento_identita", "carta_identita"),
    ("carta_di_identita", "carta_identita"),
    ("carta_di_identità", "carta_identita"),
    ("numero_telefono", "telefono"),
    ("indirizzo_email", "email"),
]

# Field labels that cut a value when they appear after its start.
FIELD_LABELS = [
    "Data", "Luogo", "Indirizzo", "Telefono", "Email", "Codice", "LinkedIn",
    "Targa", "Nome", "Cognome", "Sede", r"P\.?\s?IVA", "Profilo", "Nazionalit[àa]",
]
MAX_VALUE_LENGTH = 120

# --------------------------------------------------------------------------
# FIXED VALUES: roles
# --------------------------------------------------------------------------
PERSON_ROLE_TYPES = ["nome_cognome"]
ORG_ROLE_TYPES = ["nome_azienda", "nome_organizzazione"]
ROLE_CATEGORIES = ["persone_fisiche", "persone_giuridiche"]
OWNER_CATCH_ALL = "documento"

DOC_TYPES = ["cv", "medical", "contract", "invoice", "legal", "letter"]
DOC_TYPE_HEAD_CHARS = 800

# Document-type patterns, checked in this order on the first 800 characters.
DOC_TYPE_PATTERNS = [
    ("cv", r"curriculum\s+vitae|(?:^|\s)CV(?:\s|$|\b)|resume|lebenslauf|"
           r"données\s+personnelles|personal\s+data|dati\s+personali|persönliche\s+daten"),
    ("medical", r"cartella\s+clinica|medical\s+record|dossier\s+m[ée]dical|krankenakte|"
                r"anamnesi|diagnosi|ricovero|paziente\s*:"),
    ("legal", r"tribunale|sentenza|ricorso|ricorrente|convenuto|"
              r"n\.\s*r\.?g\.?|p\.?q\.?m\.?|udienza|ill\.?mo|"
              r"corte\s+d[i']\s+appello|procura\s+della\s+repubblica"),
    ("contract", r"contratto\s+di\s+(?:locazione|lavoro|affitto|fornitura|prestazione)|"
                 r"locatore|conduttore|datore\s+di\s+lavoro|tra\s+le\s+parti|"
                 r"\bart(?:icolo)?\.?\s*1\b|le\s+parti\s+convengono"),
    ("invoice", r"\bfattura\b|\binvoice\b|p\.?\s*iva|partita\s+iva|"
                r"imponibile|aliquota\s+iva|spett\.?le|nr?\.?\s*fattura|"
                r"causale|importo\s+totale"),
    ("letter", r"egregio|gentile|in\s+fede|cordiali\s+saluti|distinti\s+saluti|"
               r"oggetto\s*:"),
]

# Role remaps per document type: (doc_type, role, replacement).
ROLE_CONSTRAINTS = [
    ("cv", "paziente", "candidato"),
    ("cv", "medico", "candidato"),
    ("cv", "infermiere", "candidato"),
    ("cv", "dipendente", "candidato"),
    ("cv", "richiedente", "candidato"),
    ("cv", "azienda_cliente", "societa_datrice_lavoro"),
    ("cv", "organizzazione", "societa_datrice_lavoro"),
    ("medical", "candidato", "paziente"),
    ("contract", "candidato", "dipendente"),
    ("contract", "paziente", "controparte"),
    ("invoice", "candidato", "cliente"),
    ("invoice", "paziente", "cliente"),
    ("invoice", "locatore", "fornitore"),
    ("invoice", "conduttore", "cliente"),
    ("legal", "candidato", "ricorrente"),
    ("legal", "paziente", "ricorrente"),
]

PROXIMITY_DONOR_TYPES = ["nome_azienda", "nome_organizzazione", "nome_cognome"]
PROXIMITY_THRESHOLD = 200
ROLE_PROMPT_HEAD_CHARS = 3000
OWNERSHIP_PROMPT_HEAD_CHARS = 2000
PREVIEW_CHARS = 600

# --------------------------------------------------------------------------
# FIXED VALUES: placeholder labels
# --------------------------------------------------------------------------
BRACKET_PLACEHOLDER = [
    ("dati_contatto", "CONTATTO"),
    ("identificativi", "ID"),
    ("dati_finanziari", "DATO_FIN"),
    ("dati_temporali", "DATA"),
]

TYPE_PLACEHOLDER = [
    ("email", "EMAIL"),
    ("telefono", "TELEFONO"),
    ("indirizzo", "INDIRIZZO"),
    ("cap_citta", "CAP"),
    ("url", "URL"),
    ("iban", "IBAN"),
    ("numero_carta", "CARTA"),
    ("conto_bancario", "CONTO"),
    ("bic_swift", "BIC"),
    ("codice_fiscale", "CODICE_FISCALE"),
    ("passaporto", "PASSAPORTO"),
    ("patente", "PATENTE"),
    ("carta_identita", "CARTA_IDENTITA"),
    ("tessera_sanitaria", "TESSERA_SANITARIA"),
    ("targa", "TARGA"),
    ("numero_avs", "AVS"),
    ("partita_iva", "PARTITA_IVA"),
    ("numero_licenza", "LICENZA"),
    ("data_nascita", "DATA_NASCITA"),
    ("data_contratto", "DATA_CONTRATTO"),
    ("data_evento", "DATA"),
    ("scadenza", "SCADENZA"),
]

PERSON_SUBTYPE_PLACEHOLDER = [
    ("luogo_nascita", "LUOGO_NASCITA"),
    ("nazionalita", "NAZIONALITA"),
    ("data_nascita", "DATA_NASCITA"),
]

LABEL_LANGUAGES = ["en", "fr", "de"]

# Lower-case Italian token -> (en, fr, de)
LABEL_TRANSLATIONS = [
    ("contatto", "CONTACT", "CONTACT", "KONTAKT"),
    ("id", "ID", "ID", "ID"),
    ("dato_fin", "FIN_DATA", "DONNEE_FIN", "FIN_DATEN"),
    ("data", "DATE", "DATE", "DATUM"),
    ("email", "EMAIL", "EMAIL", "EMAIL"),
    ("telefono", "PHONE", "TELEPHONE", "TELEFON"),
    ("indirizzo", "ADDRESS", "ADRESSE", "ADRESSE"),
    ("cap", "ZIP", "CP", "PLZ"),
    ("url", "URL", "URL", "URL"),
    ("iban", "IBAN", "IBAN", "IBAN"),
    ("carta", "CARD", "CARTE", "KARTE"),
    ("conto", "ACCOUNT", "COMPTE", "KONTO"),
    ("bic", "BIC", "BIC", "BIC"),
    ("codice_fiscale", "TAX_ID", "CODE_FISCAL", "STEUER_ID"),
    ("passaporto", "PASSPORT", "PASSEPORT", "REISEPASS"),
    ("patente", "LICENSE", "PERMIS", "FUEHRERSCHEIN"),
    ("carta_identita", "ID_CARD", "CARTE_IDENTITE", "PERSONALAUSWEIS"),
    ("tessera_sanitaria", "HEALTH_CARD", "CARTE_SANTE", "GESUNDHEITSKARTE"),
    ("targa", "PLATE", "PLAQUE", "KENNZEICHEN"),
    ("avs", "AVS", "AVS", "AHV"),
    ("partita_iva", "VAT", "TVA", "USTID"),
    ("licenza", "LICENSE_NO", "LICENCE", "LIZENZ"),
    ("data_nascita", "BIRTH_DATE", "DATE_NAISSANCE", "GEBURTSDATUM"),
    ("data_contratto", "CONTRACT_DATE", "DATE_CONTRAT", "VERTRAGSDATUM"),
    ("scadenza", "EXPIRY", "ECHEANCE", "ABLAUF"),
    ("luogo_nascita", "BIRTH_PLACE", "LIEU_NAISSANCE", "GEBURTSORT"),
    ("nazionalita", "NATIONALITY", "NATIONALITE", "STAATSANGEH"),
    ("persona", "PERSON", "PERSONNE", "PERSON"),
    ("organizzazione", "ORGANIZATION", "ORGANISATION", "ORGANISATION"),
    ("entita", "ENTITY", "ENTITE", "ENTITAET"),
    ("candidato", "CANDIDATE", "CANDIDAT", "BEWERBER"),
    ("paziente", "PATIENT", "PATIENT", "PATIENT"),
    ("medico", "DOCTOR", "MEDECIN", "ARZT"),
    ("dottore", "DOCTOR", "DOCTEUR", "DOKTOR"),
    ("infermiere", "NURSE", "INFIRMIER", "PFLEGER"),
    ("avvocato", "LAWYER", "AVOCAT", "ANWALT"),
    ("giudice", "JUDGE", "JUGE", "RICHTER"),
    ("notaio", "NOTARY", "NOTAIRE", "NOTAR"),
    ("fornitore", "SUPPLIER", "FOURNISSEUR", "LIEFERANT"),
    ("compratore", "BUYER", "ACHETEUR", "KAEUFER"),
    ("venditore", "SELLER", "VENDEUR", "VERKAEUFER"),
    ("locatore", "LANDLORD", "BAILLEUR", "VERMIETER"),
    ("conduttore", "TENANT", "LOCATAIRE", "MIETER"),
    ("datore_lavoro", "EMPLOYER", "EMPLOYEUR", "ARBEITGEBER"),
    ("dipendente", "EMPLOYEE", "EMPLOYE", "ARBEITNEHMER"),
    ("recruiter", "RECRUITER", "RECRUTEUR", "RECRUITER"),
    ("testimone", "WITNESS", "TEMOIN", "ZEUGE"),
    ("richiedente", "APPLICANT", "DEMANDEUR", "ANTRAGSTELLER"),
    ("beneficiario", "BENEFICIARY", "BENEFICIAIRE", "BEGUENSTIGTER"),
    ("consulente", "CONSULTANT", "CONSULTANT", "BERATER"),
    ("dirigente", "MANAGER", "DIRIGEANT", "FUEHRUNGSKRAFT"),
    ("amministratore", "ADMINISTRATOR", "ADMINISTRATEUR", "VERWALTER"),
    ("rappresentante_legale", "LEGAL_REP", "REPRESENTANT_LEGAL", "GESETZL_VERTRETER"),
    ("controparte", "COUNTERPARTY", "PARTIE_ADVERSE", "GEGENPARTEI"),
    ("cliente", "CLIENT", "CLIENT", "KUNDE"),
    ("ricorrente", "CLAIMANT", "REQUERANT", "KLAEGER"),
    ("azienda_fornitrice", "SUPPLIER_COMPANY", "ENTREPRISE_FOURNISSEUR", "LIEFERFIRMA"),
    ("azienda_cliente", "CLIENT_COMPANY", "ENTREPRISE_CLIENTE", "KUNDENFIRMA"),
    ("banca", "BANK", "BANQUE", "BANK"),
    ("ente_pubblico", "PUBLIC_BODY", "ORGANISME_PUBLIC", "BEHOERDE"),
    ("ospedale", "HOSPITAL", "HOPITAL", "KRANKENHAUS"),
    ("clinica", "CLINIC", "CLINIQUE", "KLINIK"),
    ("studio_legale", "LAW_FIRM", "CABINET_AVOCATS", "ANWALTSKANZLEI"),
    ("studio_notarile", "NOTARY_FIRM", "ETUDE_NOTARIALE", "NOTARIAT"),
    ("assicurazione", "INSURER", "ASSURANCE", "VERSICHERUNG"),
    ("agenzia_immobiliare", "REAL_ESTATE_AG", "AGENCE_IMMO", "IMMOBILIENMAKLER"),
    ("societa_datrice_lavoro", "EMPLOYER_COMPANY", "SOCIETE_EMPLOYEUR", "ARBEITGEBERFIRMA"),
    ("societa_appaltatrice", "CONTRACTOR", "SOCIETE_PRESTATAIRE", "AUFTRAGNEHMERFIRMA"),
    ("fondo_pensione", "PENSION_FUND", "FONDS_PENSION", "PENSIONSKASSE"),
    ("ente_formazione", "EDUCATION_BODY", "ETABLISSEMENT_FORMATION", "BILDUNGSEINRICHTUNG"),
    ("documento", "DOCUMENT", "DOCUMENT", "DOKUMENT"),
]

# Markers that show a value swallowed an adjacent field.
BUNDLED_VALUE_PATTERN = r"\n|\s-\s|:\s"

# --------------------------------------------------------------------------
# FIXED VALUES: evaluation, ingest and retention
# --------------------------------------------------------------------------
EVAL_TRIM_CHARS = " \t\n\r.,;:!?\"'`«»“”‘’()[]{}<>"
EVAL_LANG_SUFFIXES = ["IT", "EN", "FR", "DECH", "DE"]

PLAIN_TEXT_EXTENSIONS = [".md", ".txt"]
CONVERTER_EXTENSIONS = [".pdf", ".docx", ".pptx", ".html", ".htm"]

CACHE_TTL_SECONDS = 604800
CACHE_MAX_BYTES = 500 * 1024 * 1024

DEFAULT_REVIEW_STATUS = "proposed"
REVIEW_STATUSES = ["proposed", "accepted", "removed"]
