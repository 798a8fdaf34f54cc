"""Feature vocabulary: records, units, layer depths, coefficients, bounds, class parameters.

Labels use underscores, so that every label is a plain column name.
"""

from __future__ import annotations

# --- fixed values: record number -> feature label -------------------------------------------------
FORCING_RECORDS = {
    1: "tmp", 2: "spfh", 3: "pres", 4: "ugrd", 5: "vgrd", 6: "dlwrf", 9: "pevap", 10: "apcp", 11: "dswrf",
}
MODEL_RECORDS = {
    1: "nswrs", 2: "nlwrs", 3: "lhtfl", 4: "shtfl", 5: "gflux",
    9: "asnow", 10: "arain", 11: "evp", 12: "ssrun", 13: "bgrun", 14: "snom", 17: "weasd", 18: "cnwat",
    19: "tsoil_10", 20: "tsoil_40", 21: "tsoil_100", 22: "tsoil_200",
    26: "soilm_10", 27: "soilm_40", 28: "soilm_100", 29: "soilm_200",
    30: "lsoil_10", 31: "lsoil_40", 32: "lsoil_100", 33: "lsoil_200",
    36: "evcw", 37: "trans", 38: "evbs", 50: "lai", 51: "veg",
}

# --- fixed values: feature label -> (unit, long name) ---------------------------------------------
UNITS = {
    "tmp": ("K", "Temperature"),
    "spfh": ("kg/kg", "Specific Humidity"),
    "pres": ("Pa", "Pressure"),
    "ugrd": ("m/s", "Zonal Wind"),
    "vgrd": ("m/s", "Meridional Wind"),
    "dlwrf": ("W/m^2", "Incident Longwave Flux"),
    "dswrf": ("W/m^2", "Incident Shortwave Flux"),
    "ncrain": ("%", "Convective Precip Fraction"),
    "cape": ("J/kg", "Convective Available Potential Energy"),
    "pevap": ("kg/(m^2 hr)", "Hourly Potential Evaporation"),
    "apcp": ("kg/(m^2 hr)", "Hourly Precipitation Amount"),
    "asnow": ("kg/(m^2 hr)", "Hourly Frozen Precip Amount"),
    "arain": ("kg/(m^2 hr)", "Hourly Liquid Precip Amount"),
    "evp": ("kg/(m^2 hr)", "Hourly Evapotranspiration"),
    "ssrun": ("kg/(m^2 hr)", "Hourly Surface Runoff"),
    "bgrun": ("kg/(m^2 hr)", "Hourly Sub-surface Runoff"),
    "snom": ("kg/(m^2 hr)", "Hourly Snow Melt Amount"),
    "weasd": ("kg/m^2", "Water Equivalent of Snow Depth"),
    "cnwat": ("kg/m^2", "Canopy Water Content"),
    "nswrs": ("W/m^2", "Net Shortwave Radiation"),
    "nlwrs": ("W/m^2", "Net Longwave Radiation"),
    "lhtfl": ("W/m^2", "Latent Heat Flux"),
    "shtfl": ("W/m^2", "Specific Heat Flux"),
    "gflux": ("W/m^s", "Ground Heat Flux"),
    "evcw": ("W/m^2", "Canopy Water Evaporation"),
    "trans": ("W/m^2", "Plant Transpiration"),
    "evbs": ("W/m^2", "Bare Surface Evaporation"),
    "lai": ("m^2/m^2", "Leaf Area Index"),
    "veg": ("%", "Green Vegetation Fraction"),
    "mstav_100": ("%", "0-100cm Moisture Availability"),
    "mstav_200": ("%", "0-200cm Moisture Availability"),
    "windmag": ("m^2", "Wind Speed"),
    "soilm_fc": ("kg/m^2", "0-200cm Soil Moisture Area Density"),
    "rsm_fc": ("%", "0-200cm Relative Soil Moisture"),
    "soilm_10": ("kg/m^2", "0-10cm Soil Moisture Area Density"),
    "lsoil_10": ("kg/m^2", "0-10cm Liquid Soil Moisture"),
    "tsoil_10": ("K", "0-10cm Soil Temperature"),
    "rsm_10": ("%", "0-10cm Relative Soil Moisture"),
    "soilm_40": ("kg/m^2", "10-40cm Soil Moisture Area Density"),
    "lsoil_40": ("kg/m^2", "10-40cm Liquid Soil Moisture"),
    "tsoil_40": ("K", "10-40cm Soil Temperature"),
    "rsm_40": ("%", "10-40cm Relative Soil Moisture"),
    "soilm_100": ("kg/m^2", "40-100cm Soil Moisture Area Density"),
    "lsoil_100": ("kg/m^2", "40-100cm Liquid Soil Moisture"),
    "tsoil_100": ("K", "40-100cm Soil Temperature"),
    "rsm_100": ("%", "40-100cm Relative Soil Moisture"),
    "soilm_200": ("kg/m^2", "100-200cm Soil Moisture Area Density"),
    "lsoil_200": ("kg/m^2", "100-200cm Liquid Soil Moisture"),
    "tsoil_200": ("K", "100-200cm Soil Temperature"),
    "rsm_200": ("%", "100-200cm Relative Soil Moisture"),
}

# --- fixed values: soil layers, label suffix -> (thickness in m, depth range) ----------------------
LAYERS = {
    "10": (0.1, "0-10cm"), "40": (0.3, "10-40cm"), "100": (0.6, "40-100cm"), "200": (1.0, "100-200cm"),
}
COLUMN_DEPTH = 2.0

# --- fixed values: dynamic feature -> (min, max, mean, std) ---------------------------------------
DYNAMIC_COEFFS = {
    "apcp": (0.0, 20.22250, 0.08855, 0.47219),
    "tmp": (256.75613, 311.28411, 285.62249, 5.32480),
    "pres": (64062.57812, 103205.84375, 92850.13281, 514.97894),
    "spfh": (0.00056, 0.02003, 0.00676, 0.00184),
    "ugrd": (-11.12481, 17.01286, 0.79677, 2.60494),
    "vgrd": (-14.37435, 14.93453, 0.61698, 2.95166),
    "dswrf": (0.0, 1137.35485, 193.26661, 240.59626),
    "dlwrf": (137.37471, 467.67932, 303.53692, 38.11955),
    "lai": (0.05999, 6.0, 2.94113, 0.13248),
    "veg": (0.0, 0.87129, 0.36952, 0.02366),
    "soilm_10": (3.83194, 43.56611, 24.22323, 2.33468),
    "soilm_40": (7.61064, 126.07396, 73.03880, 4.30944),
    "soilm_100": (12.0, 239.98191, 136.24519, 5.32982),
    "soilm_200": (20.00722, 463.33789, 238.34559, 5.01244),
    "weasd": (0.0, 805.42059, 4.60062, 1.53773),
    "rsm_10": (-0.4, 1.1, 0.455, 0.242),
    "rsm_40": (-0.4, 1.1, 0.458, 0.186),
    "rsm_100": (-0.4, 1.1, 0.409, 0.141),
    "rsm_200": (-0.4, 1.1, 0.421, 0.130),
    "rsm_fc": (-0.4, 1.1, 0.427, 0.122),
    "evbs": (0.0, 602.2, 11.0, 15.0),
    "trans": (0.0, 602.2, 11.0, 15.0),
    "cnwat": (0.0, 602.2, 11.0, 15.0),
    "res_rsm_10": (-0.05, 0.05, 0.0, 0.0323),
    "res_rsm_40": (-0.05, 0.05, 0.0, 0.0106),
    "res_rsm_100": (-0.05, 0.05, 0.0, 0.00384),
    "res_rsm_200": (-0.05, 0.05, 0.0, 0.00138),
    "res_rsm_fc": (-0.05, 0.05, 0.0, 0.00447),
    "tsoil_10": (None, None, 285.0, 4.8),
    "tsoil_40": (None, None, 285.0, 2.0),
    "tsoil_100": (None, None, 285.0, 1.5),
    "tsoil_200": (None, None, 285.0, 1.2),
    "res_tsoil_10": (None, None, 0.0, 0.2),
    "res_tsoil_40": (None, None, 0.0, 0.035),
    "res_tsoil_100": (None, None, 0.0, 0.0062),
    "res_tsoil_200": (None, None, 0.0, 0.0047),
}

# --- fixed values: static feature -> (mean, std) --------------------------------------------------
STATIC_COEFFS = {
    "lat": (39.0, 8.082823),
    "lon": (-96.0, 16.743118),
    "m_conus": (0.5048876231527094, 0.4999761105692122),
    "int_veg": (5.133024168719212, 4.236818527279419),
    "int_soil": (3.9223945504926108, 3.29586169355963),
    "pct_sand": (0.3289382889470443, 0.2641296532318484),
    "pct_silt": (0.289212592364532, 0.227653693553878),
    "pct_clay": (0.12368063038793105, 0.12062372678430285),
    "porosity": (0.44338217, 0.020784229),
    "fieldcap": (0.35865146, 0.031014577),
    "wiltingp": (0.06628392, 0.025511015),
    "bparam": (5.54697, 1.5926554),
    "matricp": (0.3421833, 0.23236318),
    "hydcond": (7.040321e-05, 0.00020800455),
    "elev": (717.87305, 669.2913),
    "elev_std": (62.56725, 87.51388),
    "slope": (0.2663482, 0.35235977),
    "aspect": (167.42642, 102.52077),
    "vidx": (111.5, 64.66258578188781),
    "hidx": (231.5, 133.94495137928865),
}

# --- fixed values: feature -> histogram bounds (lo, hi) -------------------------------------------
HIST_BOUNDS = {
    "tmp": (230, 330), "spfh": (0, 0.03), "pres": (60000, 105000), "ugrd": (-30, 30), "vgrd": (-30, 30),
    "dlwrf": (80, 600), "pevap": (-1, 3), "apcp": (0, 15), "dswrf": (0, 1500), "asnow": (0, 15), "arain": (0, 5),
    "evp": (-0.2, 0.75), "ssrun": (0, 110), "bgrun": (0, 2.5), "snom": (0, 10), "weasd": (0, 250), "cnwat": (0, 0.6),
    "tsoil_10": (230, 330), "tsoil_40": (230, 330), "tsoil_100": (230, 330), "tsoil_200": (230, 330),
    "evcw": (0, 200), "trans": (0, 300), "evbs": (0, 150), "lai": (0, 7), "veg": (0, 1),
    "soilm_fc": (40, 1000), "windmag": (0, 45),
    "soilm_10": (2, 50), "soilm_40": (6, 150), "soilm_100": (12, 300), "soilm_200": (20, 500),
    "res_soilm_10": (-0.5, 1.5), "res_soilm_40": (-0.5, 1.5), "res_soilm_100": (-0.5, 1.5),
    "res_soilm_200": (-0.5, 1.5), "res_soilm_fc": (-0.5, 1.5),
    "err_soilm_10": (-30, 30), "err_soilm_40": (-60, 60), "err_soilm_100": (-180, 180), "err_soilm_200": (-260, 260),
    "err_res_soilm_10": (-20, 20), "err_res_soilm_40": (-20, 20), "err_res_soilm_100": (-20, 20),
    "err_res_soilm_200": (-20, 20),
    "rsm_10": (-0.2, 1.1), "rsm_40": (-0.2, 1.1), "rsm_100": (-0.2, 1.1), "rsm_200": (-0.2, 1.1), "rsm_fc": (-0.2, 1.1),
    "res_rsm_10": (-0.15, 0.25), "res_rsm_40": (-0.05, 0.15), "res_rsm_100": (-0.025, 0.075),
    "res_rsm_200": (-0.01, 0.05), "res_rsm_fc": (-0.2, 0.4),
    "err_rsm_10": (-0.6, 0.6), "err_rsm_40": (-0.6, 0.6), "err_rsm_100": (-0.6, 0.6), "err_rsm_200": (-0.6, 0.6),
    "err_rsm_fc": (-0.6, 0.6),
    "err_res_rsm_10": (-0.05, 0.05), "err_res_rsm_40": (-0.05, 0.05), "err_res_rsm_100": (-0.05, 0.05),
    "err_res_rsm_200": (-0.05, 0.05), "err_res_rsm_fc": (-0.05, 0.05),
}

# --- fixed values: soil textures; class -> (name, short, sand, silt, clay, porosity, wiltingp, veg stress) ---
TEXTURES = {
    1: ("sand", "S", 0.92, 0.05, 0.03, 0.39500001072883606, 0.023330403491854668, 0.196),
    2: ("loamy_sand", "LS", 0.82, 0.12, 0.06, 0.42100000381469727, 0.027864687144756317, 0.248),
    3: ("sandy_loam", "SL", 0.58, 0.32, 0.10, 0.4339999854564667, 0.04695862904191017, 0.282),
    4: ("silty_loam", "SiL", 0.17, 0.70, 0.13, 0.47600001096725464, 0.08362812548875809, 0.332),
    5: ("silt", "Si", 0.10, 0.85, 0.05, 0.47600001096725464, 0.08362812548875809, 0.332),
    6: ("loam", "L", 0.43, 0.39, 0.18, 0.4390000104904175, 0.06567887216806412, 0.301),
    7: ("sandy_clay_loam", "SCL", 0.58, 0.15, 0.27, 0.40400001406669617, 0.06870032101869583, 0.293),
    8: ("silty_clay_loam", "SiCL", 0.10, 0.56, 0.34, 0.46399998664855957, 0.11954357475042343, 0.368),
    9: ("clay_loam", "CL", 0.32, 0.34, 0.34, 0.4650000035762787, 0.10322438180446625, 0.361),
    10: ("sandy_clay", "SC", 0.52, 0.06, 0.42, 0.46799999475479126, 0.12606371939182281, 0.320),
    11: ("silty_clay", "SiC", 0.06, 0.47, 0.47, 0.4569999873638153, 0.13523483276367188, 0.388),
    12: ("clay", "C", 0.22, 0.20, 0.58, 0.46399998664855957, 0.06941912323236465, 0.389),
    13: ("organic_materials", "OM", 0.0, 0.0, 0.0, None, None, 0.319),
    14: ("water", "W", 0.0, 0.0, 0.0, None, None, 0.0),
    15: ("bedrock", "BR", 0.0, 0.0, 0.0, None, None, None),
    16: ("other", "O", 0.0, 0.0, 0.0, None, None, None),
    0: ("other", "O", 0.0, 0.0, 0.0, None, None, None),
}

# --- fixed values: surface classes; class -> (name, LAI low, LAI high, minimum canopy resistance) ---
VEGETATION = {
    0: ("water", 0.06, 0.74, 400.0),
    1: ("evergreen_needleleaf", 5.0, 6.0, 300.0),
    2: ("evergreen_broadleaf", 5.0, 6.0, 300.0),
    3: ("deciduous_needleleaf", 1.0, 6.0, 300.0),
    4: ("deciduous_broadleaf", 1.0, 5.99, 175.0),
    5: ("mixed_cover", 2.88, 5.98, 175.0),
    6: ("woodland", 3.36, 5.7, 70.0),
    7: ("wooded_grassland", 1.98, 3.5, 70.0),
    8: ("closed_shrubland", 1.39, 5.07, 225.0),
    9: ("open_shrubland", 0.64, 6.0, 225.0),
    10: ("grassland", 0.65, 2.64, 35.0),
    11: ("cropland", 0.78, 3.0, 35.0),
    12: ("bare", 0.06, 0.74, 400.0),
    13: ("urban", 1.2, 4.57, 200.0),
}

# --- fixed values: slope type -> drainage ---------------------------------------------------------
DRAINAGE = {0: 0.0, 1: 0.1, 2: 0.6, 3: 1.0, 4: 0.35, 5: 0.55, 6: 0.8, 7: 0.63, 9: 0.0}

# --- fixed values: missing-value mark and default class parameters --------------------------------
FILL = 9999.0
DEFAULT_POROSITY, DEFAULT_WILTINGP = 0.45, 0.02

# --- fixed values: flux features, summed over a period rather than differenced --------------------
SUM_FEATS = ("pevap", "apcp", "asnow", "arain", "evp", "ssrun", "bgrun", "snom")

# Recipes follow from the layer thicknesses: area density (kg/m^2) <-> relative moisture in [wilting point, porosity].
RECIPES = {
    **{f"rsm_{k}": f"(soilm_{k} / {d} / 1000 - wiltingp) / (porosity - wiltingp)" for k, (d, _) in LAYERS.items()},
    "rsm_fc": "((soilm_10 + soilm_40 + soilm_100 + soilm_200) / 2000 - wiltingp) / (porosity - wiltingp)",
    "soilm_fc": "soilm_10 + soilm_40 + soilm_100 + soilm_200",
    "windmag": "sqrt(ugrd * ugrd + vgrd * vgrd)",
    "fcover": "1 - exp(-0.5D * lai)",
}


def layer_depth(feat: str) -> float:
    """Thickness in metres of the layer a soil moisture label names (`_fc` is the full column)."""
    layer = feat.rsplit("_", 1)[-1]
    return COLUMN_DEPTH if layer == "fc" else LAYERS[layer][0]
