"""Constant dimension tables.

Every table here has a fixed, small number of rows that does not grow with
the data, so joining to them with ``broadcast`` is safe at any scale.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's values for identical results).
# ---------------------------------------------------------------------------

# Known forest states, in the order of the forest metadata (alphabetical).
FOREST_STATES = [
    "A & N Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar",
    "Chandigarh", "Chhattisgarh", "Dadra & Nagar Haveli", "Daman & Diu", "Delhi",
    "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jammu & Kashmir",
    "Jharkhand", "Karnataka", "Kerala", "Lakshadweep", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Orissa",
    "Puducherry", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana",
    "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
]

COASTAL_STATES = ["Odisha", "West Bengal", "Tamil Nadu", "Andhra Pradesh", "Kerala",
                  "Karnataka", "Goa", "Maharashtra", "Gujarat"]
HILLY_STATES = ["Himachal Pradesh", "Uttarakhand", "Arunachal Pradesh", "Sikkim", "Meghalaya",
                "Manipur", "Nagaland", "Mizoram", "Tripura", "Assam"]
DRY_STATES = ["Rajasthan", "Haryana", "Punjab", "Delhi", "Gujarat"]

# Weather event classes (label-encoder order = alphabetical).
EVENT_CLASSES = ["Cloudburst", "Cyclone", "Drought", "Flood", "Hailstorm", "Heatwave",
                 "Landslide", "Thunderstorm"]

# Drought categories by SPEI band (label-encoder order = alphabetical).
DROUGHT_CATEGORIES = ["Extremely Dry", "Extremely Wet", "Moderately Dry", "Moderately Wet",
                      "Near Normal", "Severely Dry", "Severely Wet"]

# State name aliases: (alias found in the text, canonical state), in order.
STATE_ALIASES = [
    ("odisha", "Orissa"),
    ("jammu and kashmir", "Jammu & Kashmir"),
    ("andaman and nicobar", "A & N Islands"),
    ("andaman & nicobar", "A & N Islands"),
    ("dadra and nagar haveli", "Dadra & Nagar Haveli"),
    ("daman and diu", "Daman & Diu"),
    ("pondicherry", "Puducherry"),
]

# Urbanization anchors: census year -> urban share (%).
URB_ANCHORS = [(1961, 17.97), (1971, 19.91), (1981, 23.34), (1991, 25.55),
               (2001, 27.81), (2011, 31.16), (2021, 35.39)]

# City urbanization rates (%), in table order (first hit wins).
CITY_URB_RATES = [
    ("Mumbai", 93.5), ("Delhi", 97.5), ("Bangalore", 91.2), ("Hyderabad", 90.5),
    ("Chennai", 88.9), ("Kolkata", 85.3), ("Pune", 82.6), ("Ahmedabad", 88.0),
    ("Jaipur", 77.4), ("Lucknow", 72.1), ("Surat", 92.4), ("Nagpur", 74.5),
    ("Bhopal", 71.3), ("Indore", 80.2), ("Patna", 68.7), ("Kochi", 78.9),
    ("Nashik", 75.1), ("Vadodara", 83.7),
]

# State urbanization rates (%), in table order (first hit wins).
STATE_URB_RATES = [
    ("Maharashtra", 45.2), ("Tamil Nadu", 48.4), ("Kerala", 47.7), ("Karnataka", 38.6),
    ("Gujarat", 42.6), ("Punjab", 37.5), ("Haryana", 34.9), ("West Bengal", 31.9),
    ("Andhra Pradesh", 29.6), ("Uttar Pradesh", 22.3), ("Bihar", 11.3),
    ("Rajasthan", 24.9), ("Madhya Pradesh", 27.6), ("Odisha", 16.7),
    ("Jharkhand", 24.1), ("Assam", 14.1), ("Himachal Pradesh", 10.0),
    ("Uttarakhand", 30.6), ("Telangana", 38.9), ("Chhattisgarh", 23.2),
]

# Latest national row used when scoring (year 2021).
NATIONAL_LATEST = {
    "year": 2021, "population_m": 1393.41, "growth_rate": 0.97, "birth_rate": 17.4,
    "death_rate": 7.3, "world_population_m": 7837.0, "world_growth_rate": 0.94,
    "urbanization_rate": 35.39, "urban_pop_m": 493.127799,
}

# Weather codes -> label.
WEATHER_CODES = [
    (0, "Clear sky"), (1, "Mainly clear"), (2, "Partly cloudy"), (3, "Overcast"),
    (45, "Fog"), (51, "Light drizzle"), (61, "Slight rain"), (63, "Moderate rain"),
    (71, "Light snow"), (80, "Rain showers"), (95, "Thunderstorm"),
]

# Intent keywords, intents in fixed order.
INTENT_KEYWORDS = [
    ("weather", ["weather", "temperature", "rain", "forecast", "wind", "cyclone", "heatwave",
                 "cold", "hot", "humid", "climate"]),
    ("disaster", ["disaster", "flood", "risk", "calamity", "earthquake", "landslide", "storm"]),
    ("forest", ["forest", "tree", "deforestation", "cover", "woodland", "green cover", "jungle"]),
    ("crop", ["crop", "yield", "agriculture", "farm", "wheat", "rice", "harvest", "soil",
              "kharif", "rabi", "sowing"]),
    ("drought", ["drought", "spei", "dry", "water stress", "rainfall deficit", "arid", "moisture"]),
    ("population", ["population", "people", "census", "birth", "death", "urbanization",
                    "demographic"]),
    ("ndvi", ["ndvi", "vegetation index", "ndwi", "ndbi", "satellite index",
              "vegetation health", "greenness"]),
]

# Place gazetteer for location extraction.
GAZETTEER = [
    "Mumbai", "Delhi", "Bangalore", "Bengaluru", "Chennai", "Hyderabad", "Kolkata", "Pune",
    "Ahmedabad", "Jaipur", "Lucknow", "Kerala", "Rajasthan", "Maharashtra", "Gujarat",
    "Punjab", "Haryana", "Odisha", "Assam", "Telangana", "Karnataka", "Bihar", "Uttarakhand",
    "Andhra", "Sikkim", "Meghalaya", "Manipur", "Nagaland", "Tripura", "Goa", "Jharkhand",
    "Chhattisgarh", "Himachal", "Jammu", "Kashmir", "Ladakh", "Chandigarh", "Surat", "Nagpur",
    "Indore", "Bhopal", "Patna", "Vadodara", "Coimbatore", "Kochi", "Visakhapatnam", "Agra",
    "Varanasi", "Srinagar", "Amritsar", "Jodhpur", "Udaipur", "Mysuru", "Nashik",
    "Aurangabad", "Ranchi", "Guwahati", "Shillong", "Imphal",
]

# Forest alert code -> label.
ALERT_LABELS = [(0, "No Alert"), (1, "Mild Deforestation"), (2, "Severe Deforestation"),
                (3, "Critical Deforestation")]

# Model names of the readiness map, in registry order.
MODEL_NAMES = [
    "crop_yield_predictor", "drought_category_model", "drought_status_model",
    "weather_event_model", "weather_intensity_model", "forest_alert_model",
    "forest_ndvi_model", "forest_cover_model", "forest_aqi_model", "forest_human_model",
    "urban_pop_model", "urban_urb_model", "urban_infra_model", "urban_upop_model",
    "urban_grow_model",
]

# The seasons of January to December.
CROP_SEASONS = ("Rabi", "Rabi", "Summer", "Summer", "Summer", "Kharif", "Kharif", "Kharif", "Kharif", "Kharif", "Rabi", "Rabi")
WEATHER_SEASONS = ("Winter", "Winter", "Summer", "Summer", "Summer", "Monsoon", "Monsoon", "Monsoon", "Monsoon",
                   "Post-Monsoon", "Post-Monsoon", "Winter")

# Fixed values of the alert rules: (sign, limit, value), the first step that holds counts.
SPEI_BANDS = [("<=", -2.0, "Extremely Dry"), ("<=", -1.5, "Severely Dry"), ("<=", -1.0, "Moderately Dry"),
              ("<", 1.0, "Near Normal"), ("<", 1.5, "Moderately Wet"), ("<", 2.0, "Severely Wet")]
WETTEST = "Extremely Wet"
DROUGHT_SEVERITY = [("=", "Extremely Dry", "CRITICAL"), ("=", "Severely Dry", "HIGH"), ("=", "Moderately Dry", "MODERATE"),
                    ("=", "Near Normal", "NORMAL"), ("=", "Moderately Wet", "LOW"), ("=", "Severely Wet", "ELEVATED"),
                    ("=", "Extremely Wet", "ELEVATED")]
INTENSITY_LEVELS = [(">=", 8, "RED"), (">=", 4, "YELLOW")]
INTENSITY_WORDS = [("<=", 3, "Low"), ("<=", 6, "Moderate"), ("<=", 8, "High")]
ALERT_POINTS = {"ndvi": [("<", 0.15, 3), ("<", 0.3, 1)],
                "temp": [(">", 45, 3), (">", 40, 2), (">", 37, 1)],
                "wind": [(">", 80, 3), (">", 55, 2), (">", 35, 1)],
                "precip": [(">", 80, 2), (">", 50, 1)]}
COLD_POINTS = [("<", 5, 2)]
POINT_LEVELS = [(">=", 6, "RED"), (">=", 3, "YELLOW")]
POINT_LEVELS_OLD = [(">=", 6, "red"), (">=", 4, "orange"), (">=", 2, "yellow")]

# Default environment values when a payload lacks them.
DEFAULT_TEMP_C = 28.0
DEFAULT_WIND_KMH = 12.0
DEFAULT_HUMIDITY = 55.0
DEFAULT_SOLAR = 18.0
DEFAULT_SUNSHINE_H = 7.0
DEFAULT_ALTITUDE_M = 350.0
DEFAULT_SOIL = {"ph": 6.8, "organic_carbon": 0.8, "soil_moisture": 38.0}
DEFAULT_YEAR = 2017
