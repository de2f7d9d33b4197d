"""Configuration relations. The coordinates, weights and parameters are fixed values that results depend on."""

from __future__ import annotations

# Study bounds (degrees), cell (Mercator metres).
WEST, SOUTH, EAST, NORTH = -88.34, 41.48, -87.52, 42.21
CELL_M = 500.0

# Runway sites: name, lat, lon, heading, A, L, W.
AIRPORTS = [
    ("O'Hare", 41.97807408541273, -87.90902412382081, 90.0, 120.0, 7000.0, 2000.0),
    ("Midway", 41.7856116663475, -87.75331135429448, 130.0, 100.0, 6000.0, 2000.0),
    ("Lewis University Airport", 41.60690586957971, -88.09526487573747, 90.0, 90.0, 3500.0, 1500.0),
    ("Brookeridge Airpark", 41.73268507397754, -87.9972105460431, 90.0, 90.0, 4000.0, 2000.0),
]

# Route presets: name, label, then the weights of distance, population, airspace, traffic.
PRESETS = [
    ("combined", "Combined", 0.6, 0.9, 1.4, 1.0),
    ("airspace_only", "Airspace only", 0.0, 0.0, 1.0, 0.0),
    ("population_only", "Population only", 0.0, 1.0, 0.0, 0.0),
    ("distance_only", "Distance only", 1.0, 0.0, 0.0, 0.0),
    ("air_traffic_only", "Air traffic only", 0.0, 0.0, 0.0, 1.0),
]

# Endpoints: slug, lat, lon.
START = (41.695923717435235, -88.12876224517822)
DESTINATIONS = [
    ("union_station", 41.87838051825937, -87.63905525207521),
    ("ohare", 41.97807408541273, -87.90902412382081),
    ("midway", 41.7856116663475, -87.75331135429448),
]

# Traffic dates in report order.
DATASETS = ["2026-03-07", "2026-03-09", "2026-01-10", "2026-01-12", "2025-07-14", "2025-07-12"]

# Airspace rings (lat, lon): points as published, with arcs (centre, radius NM, direction, steps) between them.
ORD, MDW, LEWIS = (41.9877777778, -87.9047222222), (41.7861111111, -87.7525000000), (41.60690586957971, -88.09526487573747)
AREA_A = [
    (42.0694444444, -87.9252777778), ("arc", ORD, 5.0, "cw", 28), (41.9875000000, -87.7930555556), (41.9875000000, -87.7708333333),
    ("arc", ORD, 6.0, "cw", 40), (41.9533333333, -88.0322222222), (42.0222222222, -88.0308333333), ("arc", ORD, 6.0, "cw", 22), (42.0841666667, -87.9405555556),
]
AREA_B = [
    (42.0658333333, -87.8652777778), (42.1055555556, -87.8272222222), (42.1011111111, -87.7405555556), ("arc", ORD, 10.0, "cw", 44), (41.8261111111, -87.8500000000),
    ("arc", MDW, 5.0, "ccw", 12), (41.8163888889, -87.8561111111), ("arc", ORD, 10.5, "cw", 22), (41.8197222222, -87.9705555556), ("arc", MDW, 10.0, "cw", 14),
    (41.8277777778, -87.9680555556), ("arc", ORD, 10.0, "cw", 50), (42.1338888889, -88.0122222222), (42.0694444444, -87.9252777778), ("arc", ORD, 5.0, "cw", 10), (42.0658333333, -87.8652777778),
]
SHORE_NORTH, SHORE_SOUTH = (41.8691666667, -87.6163888889), (41.7497222222, -87.5350000000)
LAND_SHELF = [
    (41.8261111111, -87.8500000000), SHORE_NORTH, SHORE_SOUTH, ("arc", MDW, 10.0, "cw", 48), (41.8197222222, -87.9705555556),
    ("arc", ORD, 10.5, "ccw", 22), (41.8163888889, -87.8561111111), ("arc", MDW, 5.0, "ccw", 16), (41.8261111111, -87.8500000000),
]
LAKE_STEPS, CORE_STEPS, LEWIS_STEPS, WEDGE = 24, 96, 128, (322.0, 18.0, 28)
LEWIS_NM = 4.1

# The example road network: name, lat, lon; then undirected edges with weights.
TOWNS = [
    ("Bolingbrook", 41.6811, -88.1236), ("Romeoville", 41.647812, -88.087128), ("Woodridge", 41.750179, -88.043602), ("Downers Grove", 41.808861, -88.011131),
    ("Lisle", 41.801250, -88.074783), ("Naperville", 41.750839, -88.153534), ("Darien", 41.7456, -87.9811), ("Westmont", 41.7947, -87.9742),
    ("Hinsdale", 41.8006, -87.9273), ("Willowbrook", 41.7589, -87.9492), ("Burr Ridge", 41.7558, -87.9183), ("Countryside", 41.7789, -87.8739),
    ("La Grange", 41.8081, -87.8733), ("Brookfield", 41.8228, -87.8475), ("Lyons", 41.8133, -87.8220), ("Forest View", 41.8075, -87.7861),
    ("Berwyn", 41.8425, -87.7900), ("Cicero", 41.8444, -87.7592), ("Oak Park", 41.8883, -87.7894), ("Chicago", 41.8820, -87.6278),
]
ROADS = [
    ("Naperville", "Romeoville", 9), ("Naperville", "Lisle", 7), ("Naperville", "Bolingbrook", 8), ("Lisle", "Bolingbrook", 7), ("Lisle", "Downers Grove", 4),
    ("Lisle", "Woodridge", 4), ("Romeoville", "Bolingbrook", 5), ("Bolingbrook", "Downers Grove", 14), ("Bolingbrook", "Woodridge", 4), ("Bolingbrook", "Darien", 8),
    ("Downers Grove", "Darien", 6), ("Downers Grove", "Willowbrook", 7), ("Downers Grove", "Westmont", 2), ("Downers Grove", "Woodridge", 7), ("Woodridge", "Darien", 4),
    ("Darien", "Willowbrook", 2), ("Darien", "Burr Ridge", 5), ("Darien", "Westmont", 3), ("Westmont", "Willowbrook", 4), ("Westmont", "Hinsdale", 2),
    ("Hinsdale", "La Grange", 3), ("Hinsdale", "Willowbrook", 3), ("Willowbrook", "Burr Ridge", 3), ("Burr Ridge", "La Grange", 1), ("Burr Ridge", "Countryside", 1),
    ("Countryside", "La Grange", 6), ("Countryside", "Lyons", 9), ("La Grange", "Brookfield", 2), ("La Grange", "Lyons", 3), ("Brookfield", "Lyons", 2),
    ("Brookfield", "Berwyn", 4), ("Lyons", "Forest View", 2), ("Lyons", "Berwyn", 3), ("Forest View", "Cicero", 5), ("Forest View", "Berwyn", 3),
    ("Berwyn", "Oak Park", 3), ("Berwyn", "Cicero", 2), ("Cicero", "Oak Park", 3), ("Cicero", "Chicago", 8), ("Oak Park", "Chicago", 9),
]
