"""Vocabularies and limits that results depend on.

Everything here is data. Logic that uses it lives in the sibling modules.
"""

from __future__ import annotations

# --- fixed values: identifier types counted in reports -----------------------------------------
HIPAA_TYPES = [
    "NAME", "EMAIL", "PHONE_NUMBER", "SSN", "ADDRESS", "DATE", "DOB", "ZIP",
    "MRN", "INSURANCE_ID", "LICENSE_NUMBER", "EMPLOYEE_ID",
    "CREDIT_DEBIT_NUMBER", "URL", "IP_ADDRESS", "DEVICE_ID", "VEHICLE_ID",
    "BIOMETRIC_ID", "CLINICAL_TRIAL_ID", "OTHER",
]

# --- fixed values: external detector types that are medical, not identifying -------------------
MEDICAL_ENTITY_TYPES = ["DIAGNOSIS", "MEDICATION", "MEDICAL_CONDITION"]

# --- fixed values: three-digit ZIP areas with 20,000 people or fewer ---------------------------
RESTRICTED_ZIP3 = [
    "036", "692", "878", "059", "790", "879", "063", "821", "884", "102", "823", "890", "203",
    "830", "893", "556", "831",
]

# --- fixed values: words that make a capitalised phrase a non-name ------------------------------
NON_NAME_TERMS = [
    "Type", "Diabetes", "Hypertension", "Blood", "Pressure", "Heart", "Rate",
    "Glucose", "Insulin", "Metformin", "Lisinopril", "Daily", "Twice",
    "Morning", "Evening", "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "North", "South", "East", "West", "Central", "General", "Hospital",
    "Clinic", "Center", "Medical", "Health", "Care", "Service", "Department",
    "Emergency", "Primary", "Secondary", "Tertiary", "Internal", "Family",
    "Physical", "Mental", "Behavioral", "Cognitive", "Memory", "Sleep",
    "Pain", "Chronic", "Acute", "Severe", "Moderate", "Mild", "Normal",
    "Abnormal", "Positive", "Negative", "Stable", "Critical", "Fair", "Good",
    "Poor", "Excellent", "Test", "Result", "Lab", "Report", "Study",
    "Clinical", "Trial", "Research", "Protocol", "Standard", "Guideline",
]

# Words that label a field ("Patient: ..."). A label is not a name, and stays in the text.
LABEL_WORDS = [
    "Patient", "Name", "Address", "Home", "Phone", "Fax", "Email", "Doctor", "Provider", "Nurse",
    "Diagnosis", "Medications", "Medication", "Labs", "Insurance", "Member", "Policy", "License",
    "Certificate", "Plate", "Serial", "Device", "Pacemaker", "Pump", "Implant", "Fingerprint",
    "Retinal", "Voiceprint", "Employee", "Age", "Date", "Account",
]

# --- fixed values: medical content keywords (substring test) ------------------------------------
MEDICAL_KEYWORDS = [
    "diabetes", "hypertension", "depression", "anxiety", "dementia",
    "alzheimer", "cancer", "copd", "asthma", "arthritis",
    "metformin", "lisinopril", "atorvastatin", "levothyroxine",
    "amlodipine", "metoprolol", "omeprazole", "simvastatin",
    "losartan", "gabapentin", "sertraline", "insulin",
    "glucose", "hba1c", "creatinine", "cholesterol", "triglycerides",
    "hemoglobin", "platelet", "sodium", "potassium", "tsh",
    "mri", "ct scan", "x-ray", "ultrasound", "biopsy",
    "colonoscopy", "endoscopy", "catheterization",
    "diagnosis", "prognosis", "symptom", "syndrome", "disorder",
    "chronic", "acute", "bilateral", "unilateral", "stable",
    "mg", "ml", "mcg", "units", "daily", "bid", "tid", "qid",
    "prn", "po", "iv", "im", "subcutaneous",
]

# --- fixed values: care-provider titles and credentials -----------------------------------------
PROVIDER_TITLES = [
    "Dr.", "Doctor", "MD", "DO", "PhD", "RN", "NP", "PA",
    "Nurse", "Physician", "Therapist", "Psychiatrist",
    "Psychologist", "Counselor", "Pharmacist", "PharmD",
    "DDS", "DMD", "OD", "DPM", "DC", "PT", "OT", "SLP",
]
# The members of PROVIDER_TITLES that are written after a name, as in "Patricia Brown, RN".
CREDENTIALS = [
    "MD", "DO", "PhD", "RN", "NP", "PA", "PharmD", "DDS", "DMD", "OD", "DPM", "DC", "PT", "OT",
    "SLP",
]

# --- fixed values: words near a bare number that make it an insurance id ------------------------
INSURANCE_CONTEXT_WORDS = ["insurance", "member", "policy", "beneficiary"]
INSURANCE_CONTEXT_CHARS = 20

# --- fixed values: key names -------------------------------------------------------------------
IDENTIFIER_KEY_WORDS = [
    "patient_name", "name", "first_name", "last_name", "middle_name",
    "relative", "mother", "father", "spouse", "employer",
    "address", "street", "city", "state", "zip", "zipcode", "location",
    "date", "dob", "birth", "admission", "discharge", "death",
    "phone", "telephone", "mobile", "cell", "fax", "email",
    "ssn", "social", "mrn", "medical_record", "patient_id",
    "insurance", "member", "policy", "beneficiary",
    "license", "certificate", "employee_id", "staff_id",
    "device", "serial", "implant", "url", "website", "ip_address",
    "vehicle", "vin", "plate",
    "fingerprint", "retinal", "voiceprint", "biometric",
    "trial", "photo", "image", "unique_id",
]
PROVIDER_KEY_WORDS = ["provider", "doctor", "physician", "clinician", "therapist"]

# Key words that give a field its type; the first row that fits wins. An IP address is tested
# before an address, and as a word of its own, since "ip" is part of many words.
IP_KEY_PATTERN = r"(?:^|[^a-z])ip[^a-z]?address"
KEY_TYPES = [
    ("PHONE_NUMBER", ["phone", "tel", "mobile", "cell", "fax"]),
    ("EMAIL", ["email"]),
    ("ADDRESS", ["address"]),
    ("SSN", ["ssn", "social"]),
    ("MRN", ["mrn", "medical_record", "patient_id"]),
    ("DATE", ["date", "dob", "birth"]),
    ("ZIP", ["zip"]),
    ("INSURANCE_ID", ["insurance", "member", "policy", "beneficiary"]),
    ("LICENSE_NUMBER", ["license", "certificate"]),
    ("DEVICE_ID", ["device", "serial", "implant"]),
    ("URL", ["url", "website"]),
    ("EMPLOYEE_ID", ["employee_id", "eid", "staff_id"]),
    ("VEHICLE_ID", ["vehicle", "vin", "plate"]),
    ("BIOMETRIC_ID", ["fingerprint", "retinal", "voiceprint", "biometric"]),
    ("CLINICAL_TRIAL_ID", ["trial"]),
]
# The same for a field and its value together: fewer words, then the table above.
FIELD_TYPES = [
    ("PHONE_NUMBER", ["phone", "tel", "mobile", "cell", "fax"]),
    ("EMAIL", ["email"]),
    ("ADDRESS", ["address"]),
    ("SSN", ["ssn", "social"]),
    ("MRN", ["mrn", "medical_record", "patient_id"]),
    ("DATE", ["date", "dob"]),
    ("ZIP", ["zip"]),
    ("INSURANCE_ID", ["insurance", "member", "policy"]),
    ("LICENSE_NUMBER", ["license", "certificate"]),
    ("DEVICE_ID", ["device", "serial"]),
    ("URL", ["url", "website"]),
    ("EMPLOYEE_ID", ["employee_id", "eid", "staff_id"]),
]
TRIAL_VALUE_WORDS = ["nct", "clinical"]

# --- fixed values: purposes that stand for consent ---------------------------------------------
VALID_PURPOSES = ["healthcare_provision", "emergency_care", "quality_improvement"]
DEFAULT_PURPOSE = "healthcare_provision"
LEGAL_BASIS = "Article 9(2)(h)"

# --- fixed values: limits ------------------------------------------------------------------------
AGE_THRESHOLD = 90
AGE_GROUP = "90 or above"
MIN_NAME_LENGTH = 3
MIN_MRN_LENGTH = 4
RETENTION_DAYS = 90
AUDIT_RETENTION_DAYS = 2555
ERROR_ALARM = (5, 300)          # errors, seconds
UNAUTHORISED_ALARM = (1, 60)    # refused restores, seconds

# --- fixed values: operation names in the history table -----------------------------------------
ANONYMIZE_METHODS = ["ANONYMIZE", "ANONYMIZE_JSON", "ANONYMIZE_JSON_SIMPLE"]
RESTORE_METHODS = ["DE-ANONYMIZE", "DE_ANONYMIZE_JSON", "DE_ANONYMIZE_JSON_SIMPLE"]


# --- fixed values: keys of the history's metadata, and what a JSON operation says of its data there --------
META_PURPOSE, META_BASIS = "gdpr_purpose", "gdpr_legal_basis"
META_REASON, META_BY = "gdpr_access_reason", "gdpr_authorized_by"
RECORD_DATA = "json_simple"

# Names used to build pseudonyms. Our own choice; the number of entries is a power of two so that
# a hash picks them evenly.
FIRST_NAMES = [
    "Adam", "Alan", "Alice", "Amber", "Andrea", "Anna", "Arthur", "Austin",
    "Barbara", "Beth", "Brian", "Bruce", "Carl", "Carol", "Cathy", "Colin",
    "Craig", "Daniel", "Dawn", "Denise", "Derek", "Diana", "Donald", "Donna",
    "Edith", "Edward", "Elaine", "Emma", "Eric", "Ethan", "Eva", "Frank",
    "Gary", "George", "Gloria", "Grace", "Hannah", "Harold", "Heidi", "Helen",
    "Henry", "Irene", "Isaac", "Jack", "Janet", "Jason", "Julia", "Karen",
    "Keith", "Laura", "Leon", "Linda", "Lucas", "Martin", "Megan", "Nathan",
    "Nora", "Oscar", "Paula", "Peter", "Rachel", "Simon", "Tina", "Victor",
]
STREETS = [
    "Oak St", "Maple Ave", "Cedar Rd", "Elm St", "Pine Ln", "Birch Blvd", "Willow Way", "Aspen Ct",
    "Juniper Dr", "Hazel Pl", "Laurel Ave", "Spruce St", "Walnut Rd", "Poplar Ln", "Chestnut St",
    "Linden Ave",
]
CITIES = [
    "Fairview", "Midway", "Greenville", "Franklin", "Clinton", "Salem", "Georgetown", "Madison",
    "Arlington", "Ashland", "Dover", "Hudson", "Kingston", "Milton", "Newport", "Oxford",
]
