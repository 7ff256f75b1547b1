"""Curated venue metadata used by venue enrichment.

Fixed values (must equal the reference's for right results), in their natural
order: venue name, capacity, latitude, longitude, year established, pitch type.
Lookups use the normal form of the name (``functions.text.venue_key``), so
spelling variants that normalise to the same key share one entry; when two
listed names normalise to the same key, the later one wins.
"""

from __future__ import annotations

# --- fixed values (must equal the reference's) ---
CURATED_VENUES = [
    ("Wankhede Stadium", 33000, 18.9389, 72.8258, 1974, "Balanced"),
    ("M Chinnaswamy Stadium", 40000, 12.9788, 77.5996, 1969, "Flat"),
    ("MA Chidambaram Stadium", 50000, 13.0622, 80.2796, 1916, "Spin-friendly"),
    ("Arun Jaitley Stadium", 41820, 28.6379, 77.2433, 1883, "Balanced"),
    ("Eden Gardens", 68000, 22.5646, 88.3433, 1864, "Balanced"),
    ("Sawai Mansingh Stadium", 30000, 26.8940, 75.8031, 1969, "Balanced"),
    ("Rajiv Gandhi International Stadium", 55000, 17.4065, 78.5506, 2004, "Balanced"),
    ("Punjab Cricket Association IS Bindra Stadium", 26000, 30.6898, 76.7229, 1993, "Pace-friendly"),
    ("Narendra Modi Stadium", 132000, 23.0917, 72.5978, 1983, "Balanced"),
    ("Dr DY Patil Sports Academy", 55000, 19.0330, 73.0297, 2008, "Balanced"),
    ("Brabourne Stadium", 20000, 18.9322, 72.8246, 1937, "Balanced"),
    ("JSCA International Stadium Complex", 50000, 23.3441, 85.3088, 2013, "Pace-friendly"),
    ("Holkar Cricket Stadium", 30000, 22.7246, 75.8800, 1990, "Flat"),
    ("Barsapara Cricket Stadium", 45000, 26.1445, 91.7362, 2017, "Balanced"),
    ("Greenfield International Stadium", 50000, 8.5800, 76.9200, 2015, "Pace-friendly"),
    ("Himachal Pradesh Cricket Association Stadium", 23000, 32.1155, 76.3540, 2003, "Pace-friendly"),
    ("Vidarbha Cricket Association Stadium", 45000, 21.1467, 79.0828, 2008, "Balanced"),
    ("Maharashtra Cricket Association Stadium", 37000, 18.6745, 73.7068, 2012, "Pace-friendly"),
    ("Dubai International Cricket Stadium", 25000, 25.0319, 55.2192, 2009, "Pace-friendly"),
    ("Sheikh Zayed Stadium", 20000, 24.4128, 54.4720, 2004, "Balanced"),
    ("Sharjah Cricket Stadium", 27000, 25.3463, 55.4209, 1982, "Spin-friendly"),
    ("Sardar Patel Stadium, Motera", 54000, 23.0917, 72.5978, 1983, "Balanced"),
    ("Nehru Stadium", 40000, 9.9686, 76.3014, 1996, "Balanced"),
    ("Nehru Stadium, Chennai", 30000, 13.0629, 80.2750, 1965, "Balanced"),
    ("Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium", 25000, 17.7971, 83.3529, 2003, "Balanced"),
    ("Subrata Roy Sahara Stadium", 42000, 18.6397, 73.7578, 2012, "Pace-friendly"),
    ("New Wanderers Stadium", 34000, -26.1319, 28.0583, 1956, "Pace-friendly"),
    ("Kingsmead", 25000, -29.8410, 31.0252, 1923, "Pace-friendly"),
    ("St George's Park", 19000, -33.9608, 25.6022, 1888, "Balanced"),
    ("SuperSport Park", 22000, -25.8607, 28.2137, 1986, "Pace-friendly"),
    ("Buffalo Park", 20000, -33.0153, 27.9116, 1960, "Balanced"),
    ("Newlands", 25000, -33.9699, 18.4680, 1888, "Balanced"),
    ("OUTsurance Oval", 18000, -26.0833, 28.2000, 2005, "Pace-friendly"),
    ("De Beers Diamond Oval", 11500, -28.7425, 24.7622, 1973, "Balanced"),
    ("Mangaung Oval", 20000, -29.1156, 26.2052, 1989, "Balanced"),
    ("Newlands, Cape Town", 25000, -33.9699, 18.4680, 1888, "Balanced"),
    ("Willowmoore Park", 20000, -26.1875, 28.3119, 1924, "Pace-friendly"),
    ("Boland Park", 10000, -33.7358, 18.9687, 1991, "Balanced"),
    ("Feroz Shah Kotla", 41820, 28.6379, 77.2433, 1883, "Balanced"),
    ("M. A. Chidambaram Stadium", 50000, 13.0622, 80.2796, 1916, "Spin-friendly"),
    ("M Chinnaswamy Stadium, Bengaluru", 40000, 12.9788, 77.5996, 1969, "Flat"),
    ("Rajiv Gandhi International Stadium, Uppal", 55000, 17.4065, 78.5506, 2004, "Balanced"),
    ("Punjab Cricket Association Stadium, Mohali", 26000, 30.6898, 76.7229, 1993, "Pace-friendly"),
    ("BRSABV Ekana Cricket Stadium", 50000, 26.8467, 80.9462, 2017, "Balanced"),
    ("Bharat Ratna Shri Atal Bihari Vajpayee Ekana Stadium", 50000, 26.8467, 80.9462, 2017, "Balanced"),
    ("ACA Stadium", 25000, 17.7971, 83.3529, 2003, "Balanced"),
    ("Mullanpur Cricket Stadium", 38000, 30.8288, 76.7222, 2021, "Balanced"),
    ("Maharani Usharaje Trust Cricket Ground", 30000, 22.7246, 75.8800, 1990, "Flat"),
    ("Dr YS Rajasekhara Reddy ACA-VDCA Stadium", 25000, 17.7971, 83.3529, 2003, "Balanced"),
    ("Shaheed Veer Narayan Singh International Stadium", 65000, 21.2514, 81.6296, 2008, "Balanced"),
    ("Saurashtra Cricket Association Stadium", 28000, 22.3094, 70.8022, 2008, "Balanced"),
    ("M. Chinnaswamy Stadium", 40000, 12.9788, 77.5996, 1969, "Flat"),
    ("Wankhede Stadium, Mumbai", 33000, 18.9389, 72.8258, 1974, "Balanced"),
    ("Eden Gardens, Kolkata", 68000, 22.5646, 88.3433, 1864, "Balanced"),
    ("Nehru Stadium, Kochi", 40000, 9.9686, 76.3014, 1996, "Balanced"),
    ("Sawai Mansingh Stadium, Jaipur", 30000, 26.8940, 75.8031, 1969, "Balanced"),
    ("Dr DY Patil Stadium", 55000, 19.0330, 73.0297, 2008, "Balanced"),
    ("Brabourne Stadium, Mumbai", 20000, 18.9322, 72.8246, 1937, "Balanced"),
    ("Narendra Modi Stadium, Ahmedabad", 132000, 23.0917, 72.5978, 1983, "Balanced"),
    ("Zayed Cricket Stadium", 20000, 24.4128, 54.4720, 2004, "Balanced"),
    ("Dubai Sports City Cricket Stadium", 25000, 25.0319, 55.2192, 2009, "Pace-friendly"),
    ("Sharjah Stadium", 27000, 25.3463, 55.4209, 1982, "Spin-friendly"),
]
# --- end fixed values ---
