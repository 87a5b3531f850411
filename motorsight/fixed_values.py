"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced for results to match: thresholds, labels, lookup tables and message
texts.  They are stated plainly, in their natural order, and nothing else lives
here.  Operators turn these tables into small literal DataFrames or ``when``
chains; no logic is kept in this file.
"""

# --- Physics ---------------------------------------------------------------
TWO_PI_OVER_60 = 0.10471975511965977  # 2*pi/60, rad/s per rpm

# Feature-set limits (training features)
FEATURE_HDF_DT = 8.6
FEATURE_HDF_RPM = 1380.0
FEATURE_TWF_WEAR = 200.0
FEATURE_OSF_WT = 13000.0
FEATURE_PWF_LOW = 3500.0
FEATURE_PWF_HIGH = 9500.0

# Diagnostic rule-set limits (likely failure modes)
DIAG_TWF_WEAR = 180.0
DIAG_HDF_DT = 8.6
DIAG_HDF_RPM = 1380.0
DIAG_PWF_LOW = 3500.0
DIAG_PWF_HIGH = 9500.0
DIAG_OSF_WT = 12000.0

# Dataset specification limits (failure definition)
SPEC_HDF_DT = 8.6
SPEC_HDF_RPM = 1380.0
SPEC_PWF_LOW = 3500.0
SPEC_PWF_HIGH = 9000.0
SPEC_TWF_WEAR_LOW = 200.0
SPEC_TWF_WEAR_HIGH = 240.0
SPEC_OSF_BY_TYPE = {"L": 11000.0, "M": 12000.0, "H": 13000.0}

FAILURE_MODE_ORDER = ["TWF", "HDF", "PWF", "OSF"]
NO_MODE = "—"

# Defaults for absent sensors at scoring time
SCORING_DEFAULTS = {
    "air_k": 300.0,
    "proc_k": 310.0,
    "torque": 40.0,
    "wear": 0.0,
    "type_enc": 1,
}
OLD_SCORING_DEFAULTS = {"air_k": 298.15, "proc_k": 308.15, "rpm": 1500.0,
                        "torque": 40.0, "wear": 0.0, "type_enc": 1}
PRODUCTION_RPM_MEAN = 1538.231142857143
PRODUCTION_THRESHOLD = 0.42

# Physical bounds for input validation, inclusive (canonical column, label, lo, hi)
SENSOR_BOUNDS = [
    ("air_k", "Air temperature [K]", 270.0, 380.0),
    ("proc_k", "Process temperature [K]", 270.0, 420.0),
    ("rpm", "Rotational speed [rpm]", 100.0, 3000.0),
    ("torque", "Torque [Nm]", 0.0, 200.0),
    ("wear", "Tool wear [min]", 0.0, 300.0),
]
ANOMALY_SCORE_LIMIT = -0.3

# Motor class code by machine type name (Heavy 2 / Medium 1 / Light 0), default 1
MOTOR_TYPE_MAP = {
    "KIRICI": 2, "PELET_MOTOR": 2, "KARISTIRICI": 2,
    "ELEVATOR": 1, "VIDA": 1, "KONDISYONER": 1,
    "MELASOR": 1, "GRANUL": 1, "ELEK": 1,
    "POMPA": 0, "ASPIRATOR": 0, "SOGUTUCU": 0,
    "BESLEYICI": 0, "ZINCIRLI": 0, "VIBRO": 0,
}
MOTOR_TYPE_DEFAULT = 1
# Product type code used everywhere in this library (L=0, M=1, H=2)
PRODUCT_TYPE_CODE = {"L": 0, "M": 1, "H": 2}

# --- Risk scales -------------------------------------------------------------
# Five French levels: (lower bound inclusive, level, action, icon)
RISK_LEVELS_FR = [
    (0.80, "CRITIQUE", "Arrêt immédiat machine — STOP NOW", "🔴"),
    (0.60, "URGENT", "Maintenance urgente dans 24h", "🟠"),
    (0.40, "ATTENTION", "Planifier maintenance dans 3-5 jours", "🟡"),
    (0.20, "SURVEILLER", "Surveiller — prochaine inspection planif", "🔵"),
    (0.00, "NORMAL", "Fonctionnement normal", "🟢"),
]
RISK_ORDER_FR = ["NORMAL", "SURVEILLER", "ATTENTION", "URGENT", "CRITIQUE"]
TTF_TEXT_FR = {
    "CRITIQUE": "1–3 jours",
    "URGENT": "3–7 jours",
    "ATTENTION": "7–14 jours",
    "SURVEILLER": "14–30 jours",
    "NORMAL": "> 30 jours",
}
# Four English levels (config risk thresholds)
RISK_LEVELS_EN4 = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")]
RISK_EN4_ELSE = "LOW"
# Five English levels with actions
RISK_LEVELS_EN5 = [
    (0.80, "CRITICAL", "STOP NOW -- Emergency inspection required."),
    (0.60, "HIGH", "URGENT -- Maintain within 24 hours."),
    (0.40, "MEDIUM", "CAUTION -- Plan maintenance in 3-5 days."),
    (0.20, "LOW", "WATCH -- Monitor more frequently."),
    (0.00, "NORMAL", "OK -- No anomaly detected."),
]
# Days to failure steps, percent probability
DAYS_STEPS_4 = [(80.0, 1), (60.0, 3), (40.0, 5)]
DAYS_STEPS_4_ELSE = 7
DAYS_STEPS_5 = [(0.80, 1), (0.60, 3), (0.40, 5), (0.20, 7), (0.00, 14)]
DAYS_STEPS_5_ELSE = 30
# English/French risk key normalisation, default NORMAL
RISK_NORMALIZE = {
    "CRITICAL": "CRITIQUE", "HIGH": "URGENT",
    "MEDIUM": "ATTENTION", "LOW": "SURVEILLER",
    "CRITIQUE": "CRITIQUE", "URGENT": "URGENT",
    "ATTENTION": "ATTENTION", "SURVEILLER": "SURVEILLER",
    "NORMAL": "NORMAL",
}
# Alert icon by probability
ALERT_ICONS = [(0.8, "🔴"), (0.5, "🟡")]
ALERT_ICON_ELSE = "🟢"
URGENT_PCT = 60.0

# Ensemble weights (base, retry)
ENSEMBLE_WEIGHTS = {"rf": 1.0, "xgb": 2.0, "lgb": 2.0}
ENSEMBLE_WEIGHTS_RETRY = {"rf": 1.0, "xgb": 3.0, "lgb": 2.0}

# Quality gates: name -> {metric: minimum}
QUALITY_GATES = {
    "final": {"precision": 0.72, "recall": 0.80, "f1": 0.76, "roc_auc": 0.97},
    "production": {"precision": 0.80, "recall": 0.80, "f1": 0.82, "roc_auc": 0.95},
    "notebook": {"precision": 0.85, "recall": 0.80, "f1": 0.82, "roc_auc": 0.95},
    "library": {"precision": 0.80, "recall": 0.75, "f1": 0.77},
}
FBETA_BETA = 1.5
FBETA_BETA_RETRY = 2.0

# Drift
DRIFT_P_LIMIT = 0.05
DRIFT_MIN_LIVE_ROWS = 30
DRIFT_CRITICAL_COUNT = 3
RETRAIN_MIN_NEW_LABELS = 100
RETRAIN_F1_DROP = 0.05

# Alarm log
ALARM_REQUIRED_COLUMNS = ["DateTime", "Instance", "CLASS", "TxtCame"]
ALARM_FAULT_CLASSES = ["ALMTD", "CRASD", "CRPRD"]

# Manual entry value ranges (sensor, lo, hi); near-limit margin 10 % of the span
ENTRY_VALUE_RANGES = [
    ("temperature", 0.0, 200.0),
    ("pressure", 0.0, 50.0),
    ("vibration", 0.0, 20.0),
    ("speed", 0.0, 5000.0),
    ("power", 0.0, 500.0),
    ("current", 0.0, 100.0),
]
NEAR_LIMIT_FRACTION = 0.1
READING_FREQUENCY_MIN = 480
LOW_CONFIDENCE = 0.7

# Model comparison limits used by the accuracy check
ACCURACY_LIMITS = {"accuracy": 0.80, "precision": 0.80, "recall": 0.75, "f1": 0.77, "roc_auc": 0.90}

# --- Failure-mode knowledge (French diagnostic report) -----------------------
FAILURE_DETAILS = {
    "TWF": {
        "nom": "Défaut d'usure d'outil (TWF)",
        "cause": (
            "L'usure de l'élément mécanique a dépassé le seuil critique (≥ 200 min). "
            "Les frottements et les contraintes mécaniques augmentent, "
            "entraînant une dégradation accélérée des composants."
        ),
        "actions": [
            "1. Arrêter la machine et inspecter l'outil ou la pièce usée.",
            "2. Remplacer l'élément défaillant par une pièce conforme.",
            "3. Inspecter les roulements et le palier de l'arbre.",
            "4. Effectuer un contrôle d'alignement de l'axe moteur.",
            "5. Réaliser une analyse vibratoire après remplacement.",
        ],
        "siemens_param": "Vérifier le compteur d'heures de marche dans le bloc FC (OB1 / DB_Moteur).",
        "schneider_param": "Consulter le registre Modbus MW120 (wear counter) via EcoStruxure.",
    },
    "HDF": {
        "nom": "Défaut de dissipation thermique (HDF)",
        "cause": (
            "La différence entre la température de process et la température ambiante "
            "est inférieure à 8,6 K, combinée à une vitesse de rotation inférieure à 1 380 tr/min. "
            "Le système de refroidissement est insuffisant — risque de surchauffe des enroulements."
        ),
        "actions": [
            "1. Nettoyer le ventilateur et les ailettes de refroidissement du moteur.",
            "2. Vérifier l'obstruction des grilles d'aération.",
            "3. Contrôler la température ambiante de la salle de machines.",
            "4. Vérifier le bon fonctionnement du ventilateur externe (si présent).",
            "5. Mesurer la résistance des enroulements à froid et à chaud.",
        ],
        "siemens_param": "Vérifier le bloc de protection thermique PT100 dans WinCC (TagName: MotorTemp).",
        "schneider_param": "Vérifier le relais de protection thermique TeSys D / GV3 (classe 10A).",
    },
    "PWF": {
        "nom": "Défaut de puissance (PWF)",
        "cause": (
            "La puissance mécanique calculée (P = C × ω) est en dehors de la plage nominale "
            "[3 500 – 9 500 W]. Cela peut indiquer une surcharge, une sous-charge anormale, "
            "un défaut du variateur de fréquence (VFD), ou un problème d'alimentation."
        ),
        "actions": [
            "1. Vérifier la charge mécanique raccordée au moteur.",
            "2. Contrôler les paramètres du variateur (fréquence, courant limite).",
            "3. Mesurer la tension et le courant d'alimentation (trois phases).",
            "4. Vérifier les protections thermiques (relais, disjoncteur).",
            "5. Contrôler l'état des condensateurs de compensation si présents.",
        ],
        "siemens_param": "Vérifier le bloc de régulation dans le variateur Sinamics S120/G120 (r0027 = courant actuel).",
        "schneider_param": "Consulter les paramètres ATV320/ATV630 : P1.2 (courant nominal), F602 (défaut surcharge).",
    },
    "OSF": {
        "nom": "Défaut de surcontrainte (OSF)",
        "cause": (
            "L'indice de surcontrainte (usure × couple) dépasse 13 000 Nm·min. "
            "Le moteur ou la transmission fonctionne au-delà de ses limites de conception, "
            "risquant une rupture mécanique ou un défaut d'arbre."
        ),
        "actions": [
            "1. Réduire immédiatement la charge ou le couple appliqué.",
            "2. Inspecter les accouplements et la transmission mécanique.",
            "3. Vérifier le dimensionnement du moteur par rapport à la charge réelle.",
            "4. Planifier une révision complète de la ligne de transmission.",
            "5. Vérifier l'état des garnitures d'étanchéité et du joint d'arbre.",
        ],
        "siemens_param": "Activer le limiteur de couple dans TIA Portal (FB_DriveControl, paramètre p1520).",
        "schneider_param": "Configurer la limite de couple dans EcoStruxure (F612 = limite couple moteur).",
    },
    "RNF": {
        "nom": "Défaut aléatoire (RNF)",
        "cause": (
            "Défaillance aléatoire détectée. Ce type de défaut peut résulter d'une anomalie "
            "électrique transitoire, d'une perturbation EMI, d'un défaut de capteur, "
            "ou d'une cause externe non prévue."
        ),
        "actions": [
            "1. Inspecter le câblage et toutes les connexions électriques.",
            "2. Vérifier l'état et la calibration des capteurs et transmetteurs.",
            "3. Consulter les journaux d'alarmes SCADA/WinCC (AlarmLogging).",
            "4. Effectuer un test d'isolement (Megger test ≥ 1 MΩ).",
            "5. Vérifier la mise à la terre du moteur et du tableau électrique.",
        ],
        "siemens_param": "Consulter le journal diagnostic dans WinCC : HMI#MEE1Alg (AlarmLogging).",
        "schneider_param": "Vérifier le registre de défaut F600 dans l'ATV via PowerSuite.",
    },
}

RISK_DESCRIPTIONS = {
    "CRITIQUE": "⛔ ARRÊT IMMÉDIAT REQUIS — Défaillance imminente dans 1 à 3 jours.",
    "URGENT": "🚨 INTERVENTION URGENTE — Maintenance dans les 3 à 7 jours.",
    "ATTENTION": "⚠️  ATTENTION — Planifier une maintenance dans 7 à 14 jours.",
    "SURVEILLER": "🔵 SURVEILLANCE — Augmenter la fréquence de contrôle (14–30 jours).",
    "NORMAL": "✅ ÉTAT NORMAL — Aucune anomalie détectée. Prochain contrôle préventif selon planning.",
}

MAINTENANCE_SCHEDULES = {
    "CRITIQUE": [
        "⛔ Arrêter la machine IMMÉDIATEMENT.",
        "→ Convoquer l'équipe de maintenance d'urgence.",
        "→ Ne pas remettre en marche avant inspection complète.",
        "→ Notifier le responsable de production.",
    ],
    "URGENT": [
        "🚨 Planifier une intervention dans les 48–72 heures.",
        "→ Réduire la charge de la machine si possible.",
        "→ Augmenter la fréquence de surveillance (toutes les 2 heures).",
        "→ Préparer les pièces de rechange nécessaires.",
    ],
    "ATTENTION": [
        "⚠️  Planifier une inspection dans la semaine en cours.",
        "→ Effectuer une vérification quotidienne des paramètres.",
        "→ Préparer le plan de maintenance préventive.",
        "→ Vérifier la disponibilité des pièces en stock.",
    ],
    "SURVEILLER": [
        "🔵 Surveiller les paramètres avec une fréquence accrue.",
        "→ Intégrer à la prochaine révision périodique (< 30 jours).",
        "→ Documenter l'évolution des tendances dans le GMAO.",
    ],
    "NORMAL": [
        "✅ Continuer selon le planning de maintenance préventive.",
        "→ Prochain contrôle selon la fiche technique du moteur.",
        "→ Archiver ce rapport dans le dossier machine.",
    ],
}
SCHEDULE_FALLBACK = "Consulter le responsable maintenance."

RECOMMENDATIONS_EN = {
    "CRITICAL": "⚠️ IMMEDIATE ACTION REQUIRED:\n"
                "- Stop machine operation immediately\n"
                "- Conduct emergency inspection\n"
                "- Replace critical components\n"
                "- Do not restart until cleared by maintenance team",
    "HIGH": "🔴 URGENT MAINTENANCE NEEDED:\n"
            "- Schedule maintenance within 24 hours\n"
            "- Inspect all sensors showing abnormal readings\n"
            "- Prepare replacement parts\n"
            "- Monitor continuously until maintenance",
    "MEDIUM": "🟡 SCHEDULE PREVENTIVE MAINTENANCE:\n"
              "- Plan maintenance within 3-5 days\n"
              "- Monitor sensor trends closely\n"
              "- Order necessary parts\n"
              "- Continue normal operation with caution",
    "LOW": "🟢 CONTINUE NORMAL OPERATION:\n"
           "- Maintain regular monitoring schedule\n"
           "- No immediate action required\n"
           "- Follow standard maintenance schedule",
}
RECOMMENDATION_FALLBACK = "Unable to determine recommendation"

# Report frame (French diagnostic report)
REPORT_RULE = "=" * 68
REPORT_SUBRULE = "─" * 68
REPORT_MODEL_NAME = "XGBoost + LightGBM Ensemble (Optuna tuned)"

# The texts of the French diagnostic report, in its order
REPORT_TEXTS = {
    "title": "  RAPPORT DE MAINTENANCE PRÉDICTIVE — MOTEUR ASYNCHRONE",
    "system": "  Système  : Prédiction de défaillance (IA / Machine Learning)",
    "maker": "  Fabriquant: {} (Algérie)",
    "machine": "  Machine ID    : ",
    "stamp": "  Date / Heure  : ",
    "model": "  Modèle IA     : ",
    "result": "  RÉSULTAT DU DIAGNOSTIC",
    "probability": "  Probabilité de défaillance : ",
    "risk": "  Niveau de risque           : ",
    "delay": "  Délai estimé avant panne   : ",
    "confidence": "  Confiance du modèle        : ",
    "meaning": "  → ",
    "sensors": "  DONNÉES CAPTEURS (snapshot)",
    "air": "  Température ambiante  : ",
    "motor": "  Température moteur    : ",
    "rpm": "  Vitesse de rotation   : ",
    "torque": "  Couple                : ",
    "wear": "  Usure / Heures marche : ",
    "power": "  Puissance mécanique   : ",
    "difference": "  ΔT (process − ambiant): ",
    "low": "⚠️ FAIBLE",
    "modes": "  MODES DE DÉFAILLANCE IDENTIFIÉS",
    "mode": "  ▶ ",
    "cause": "    Cause : ",
    "actions": "    Actions correctives :",
    "planning": "  RECOMMANDATION DE PLANIFICATION",
}
REPORT_VENDOR = {"SIEMENS": "    Siemens : ", "SCHNEIDER": "    Schneider: "}
REPORT_NO_MODE = ["  Aucun mode de défaillance spécifique détecté.", "  Surveillance générale recommandée."]
REPORT_CLOSING = [
    "  Ce rapport est généré automatiquement par le système IA de",
    "  maintenance prédictive. Il ne remplace pas le jugement d'un",
    "  technicien qualifié. Conserver ce document dans le registre",
    "  de maintenance de l'installation.",
]

# Alert message pieces, French and Arabic
ALERT_TITLE = {"fr": "*Alerte Maintenance Urgente*", "ar": "*تحذير صيانة عاجلة*"}
ALERT_MACHINE = {"fr": "🔧 Machine: ", "ar": "🔧 الآلة: "}
ALERT_FAILURE = {"fr": "⚠️ Type de panne prévue: ", "ar": "⚠️ نوع العطل المتوقع: "}
ALERT_PROB = {"fr": "📊 Probabilité: ", "ar": "📊 احتمالية العطل: "}
ALERT_REMAIN = {"fr": "⏰ Temps restant: ~", "ar": "⏰ الوقت المتبقي: ~"}
ALERT_HOURS = {"fr": "h", "ar": " ساعة"}
ALERT_DAYS = {"fr": " jours", "ar": " يوم"}
ALERT_CLOSING = {"fr": "✅ Action immédiate requise", "ar": "✅ يرجى اتخاذ الإجراءات اللازمة فورًا"}
SUMMARY_TITLE = {"fr": "📊 *Résumé Quotidien - Maintenance Prédictive*",
                 "ar": "📊 *ملخص يومي - نظام الصيانة التنبؤية*"}
SUMMARY_CRITICAL = {"fr": "🔴 Alertes critiques: ", "ar": "🔴 تنبيهات عاجلة: "}
SUMMARY_AT_RISK = {"fr": "⚠️ Machines à risque: ", "ar": "⚠️ آلات في خطر: "}
SUMMARY_CLOSING = {"fr": "✅ Consultez le système pour plus de détails",
                   "ar": "✅ تحقق من النظام للحصول على التفاصيل"}

# Work shifts: morning 6-14, afternoon 14-22, else night; working hours 8-18
SHIFT_MORNING = (6, 14)
SHIFT_AFTERNOON = (14, 22)
WORKING_HOURS = (8, 18)

# Rolling windows and lags of the ordered feature set
ROLLING_WINDOWS = [3, 7, 14, 30]
LAGS = [1, 2, 3, 5, 7]
TREND_WINDOW = 7
BASELINE_WINDOW = 30
FAILURE_HORIZONS = [1, 3, 7]

# Spoken number words by language (first known word wins)
NUMBER_WORDS_AR = {
    "صفر": 0, "واحد": 1, "اثنين": 2, "ثلاثة": 3, "أربعة": 4,
    "خمسة": 5, "ستة": 6, "سبعة": 7, "ثمانية": 8, "تسعة": 9,
    "عشرة": 10, "عشرين": 20, "ثلاثين": 30, "أربعين": 40,
    "خمسين": 50, "ستين": 60, "سبعين": 70, "ثمانين": 80, "تسعين": 90,
    "مئة": 100, "مائة": 100,
}
NUMBER_WORDS_FR = {
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4,
    "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9,
    "dix": 10, "vingt": 20, "trente": 30, "quarante": 40,
    "cinquante": 50, "soixante": 60, "soixante-dix": 70,
    "quatre-vingt": 80, "quatre-vingt-dix": 90, "cent": 100,
}
NUMBER_WORDS_EN = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4,
    "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80,
    "ninety": 90, "hundred": 100,
}
# Number patterns: OCR text (after removing spaces, comma -> dot) and transcripts
OCR_NUMBER_PATTERN = r"[-+]?\d*\.?\d+"
SPEECH_NUMBER_PATTERN = r"\d+\.?\d*"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EASTERN_ARABIC_INDIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹"

# The model's features, in its order
FEATURE_COLUMNS = [
    "Air_temperature__K", "Process_temperature__K", "Rotational_speed__rpm", "Torque__Nm",
    "Tool_wear__min", "Type_enc", "Power_W", "Temp_Diff_K", "Wear_Torque", "Mechanical_Stress",
    "Thermal_Ratio", "Speed_Deviation", "HDF_signal", "TWF_signal", "OSF_signal", "PWF_low",
    "PWF_high", "log_Rotational_speed__rpm", "sqrt_Rotational_speed__rpm", "log_Torque__Nm",
    "sqrt_Torque__Nm", "log_Tool_wear__min", "sqrt_Tool_wear__min", "log_Power_W",
    "sqrt_Power_W", "log_Wear_Torque", "sqrt_Wear_Torque", "RPM_x_Temp", "Torque_x_TempDiff",
    "Wear_x_Power", "Wear_x_Torque_sq", "Torque_sq", "RPM_sq", "TempDiff_sq", "RPM_x_Wear",
    "Temp_x_Wear",
]

# Map keys accepted for each canonical sensor: SCADA tag (with its unit change) or label.
SENSOR_MAP_KEYS = {
    "air_k": [("AmbientTemp", 273.15, 1.0), ("Air temperature [K]", 0.0, 1.0)],
    "proc_k": [("MotorTemp", 273.15, 1.0), ("Process temperature [K]", 0.0, 1.0)],
    "rpm": [("Speed_RPM", 0.0, 1.0), ("Rotational speed [rpm]", 0.0, 1.0)],
    "torque": [("Torque_Nm", 0.0, 1.0), ("Torque [Nm]", 0.0, 1.0)],
    "wear": [("RunHours", 0.0, 60.0), ("Tool wear [min]", 0.0, 1.0)],
}
