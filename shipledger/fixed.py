"""Fixed values that results depend on."""

# Names of the major OS versions.
OS_RELEASE_NAMES = {
    11: "Big Sur",
    12: "Monterey",
    13: "Ventura",
    14: "Sonoma",
    15: "Sequoia",
    26: "Tahoe",
    27: "Golden Gate",
}

# Chip families as (display name, tier, architecture suffixes).
CHIP_FAMILIES = [
    ("A12Z (DTK)", "base", ["T8020"]),
    ("A18 Pro", "pro", ["T8140"]),
    ("M1", "base", ["T8101", "T8103"]),
    ("M1 Pro", "pro", ["T6000"]),
    ("M1 Max", "max", ["T6001"]),
    ("M1 Ultra", "ultra", ["T6002"]),
    ("M2", "base", ["T8110", "T8112"]),
    ("M2 Pro", "pro", ["T6020"]),
    ("M2 Max", "max", ["T6021"]),
    ("M2 Ultra", "ultra", ["T6022"]),
    ("M3", "base", ["T8122"]),
    ("M3 Pro", "pro", ["T6030"]),
    ("M3 Max", "max", ["T6031", "T6034"]),
    ("M3 Ultra", "ultra", ["T6032"]),
    ("M4", "base", ["T8132"]),
    ("M4 Pro", "pro", ["T6040"]),
    ("M4 Max", "max", ["T6041"]),
    ("M4 Ultra", "ultra", ["T6042"]),
    ("M5", "base", ["T8142"]),
    ("M5 Pro", "pro", ["T6050"]),
    ("M5 Max", "max", ["T6051"]),
    ("M5 Ultra", "ultra", ["T6052"]),
    ("Virtual Mac", "base", ["VMAPPLE"]),
]

# Order of chip tiers.
CHIP_TIERS = ["base", "pro", "max", "ultra"]

# Device models as (model, chip, marketing name).
DEVICES = [
    ("MacBookAir10,1", "M1", "MacBook Air (M1, Late 2020)"),
    ("MacBookPro17,1", "M1", "MacBook Pro (13-inch, M1, Late 2020)"),
    ("Macmini9,1", "M1", "Mac mini (M1, Late 2020)"),
    ("iMac21,1", "M1", "iMac (24-inch, M1, 2021) 2-port"),
    ("iMac21,2", "M1", "iMac (24-inch, M1, 2021) 4-port"),
    ("MacBookPro18,1", "M1 Pro", "MacBook Pro (16-inch, M1 Pro, Late 2021)"),
    ("MacBookPro18,3", "M1 Pro", "MacBook Pro (14-inch, M1 Pro, Late 2021)"),
    ("MacBookPro18,2", "M1 Max", "MacBook Pro (16-inch, M1 Max, Late 2021)"),
    ("MacBookPro18,4", "M1 Max", "MacBook Pro (14-inch, M1 Max, Late 2021)"),
    ("Mac13,1", "M1 Max", "Mac Studio (M1 Max, 2022)"),
    ("Mac13,2", "M1 Ultra", "Mac Studio (M1 Ultra, 2022)"),
    ("Mac14,2", "M2", "MacBook Air (13-inch, M2, 2022)"),
    ("Mac14,7", "M2", "MacBook Pro (13-inch, M2, 2022)"),
    ("Mac14,3", "M2", "Mac mini (M2, 2023)"),
    ("Mac14,15", "M2", "MacBook Air (15-inch, M2, 2023)"),
    ("Mac14,9", "M2 Pro", "MacBook Pro (14-inch, M2 Pro, 2023)"),
    ("Mac14,10", "M2 Pro", "MacBook Pro (16-inch, M2 Pro, 2023)"),
    ("Mac14,12", "M2 Pro", "Mac mini (M2 Pro, 2023)"),
    ("Mac14,5", "M2 Max", "MacBook Pro (14-inch, M2 Max, 2023)"),
    ("Mac14,6", "M2 Max", "MacBook Pro (16-inch, M2 Max, 2023)"),
    ("Mac14,13", "M2 Max", "Mac Studio (M2 Max, 2023)"),
    ("Mac14,14", "M2 Ultra", "Mac Studio (M2 Ultra, 2023)"),
    ("Mac14,8", "M2 Ultra", "Mac Pro (M2 Ultra, 2023)"),
    ("Mac15,3", "M3", "MacBook Pro (14-inch, M3, Late 2023)"),
    ("Mac15,4", "M3", "iMac (24-inch, M3, 2023) 2-port"),
    ("Mac15,5", "M3", "iMac (24-inch, M3, 2023) 4-port"),
    ("Mac15,12", "M3", "MacBook Air (13-inch, M3, 2024)"),
    ("Mac15,13", "M3", "MacBook Air (15-inch, M3, 2024)"),
    ("Mac15,6", "M3 Pro", "MacBook Pro (14-inch, M3 Pro, Late 2023)"),
    ("Mac15,7", "M3 Pro", "MacBook Pro (16-inch, M3 Pro, Late 2023)"),
    ("Mac15,8", "M3 Max", "MacBook Pro (14-inch, M3 Max, Late 2023)"),
    ("Mac15,9", "M3 Max", "MacBook Pro (16-inch, M3 Max, Late 2023)"),
    ("Mac15,10", "M3 Max", "MacBook Pro (14-inch, M3 Max, Late 2023)"),
    ("Mac15,11", "M3 Max", "MacBook Pro (16-inch, M3 Max, Late 2023)"),
    ("Mac15,14", "M3 Ultra", "Mac Studio (M3 Ultra, 2025)"),
    ("Mac16,1", "M4", "MacBook Pro (14-inch, M4, Late 2024)"),
    ("Mac16,2", "M4", "iMac (24-inch, M4, 2024) 2-port"),
    ("Mac16,3", "M4", "iMac (24-inch, M4, 2024) 4-port"),
    ("Mac16,10", "M4", "Mac mini (M4, 2024)"),
    ("Mac16,12", "M4", "MacBook Air (13-inch, M4, 2025)"),
    ("Mac16,13", "M4", "MacBook Air (15-inch, M4, 2025)"),
    ("Mac16,7", "M4 Pro", "MacBook Pro (16-inch, M4 Pro, Late 2024)"),
    ("Mac16,8", "M4 Pro", "MacBook Pro (14-inch, M4 Pro, Late 2024)"),
    ("Mac16,11", "M4 Pro", "Mac mini (M4 Pro, 2024)"),
    ("Mac16,5", "M4 Max", "MacBook Pro (16-inch, M4 Max, Late 2024)"),
    ("Mac16,6", "M4 Max", "MacBook Pro (14-inch, M4 Max, Late 2024)"),
    ("Mac16,9", "M4 Max", "Mac Studio (M4 Max, 2025)"),
    ("Mac17,2", "M5", "MacBook Pro (14-inch, M5, 2025)"),
    ("Mac17,3", "M5", "MacBook Air (13-inch, M5, 2026)"),
    ("Mac17,4", "M5", "MacBook Air (15-inch, M5, 2026)"),
    ("Mac17,6", "M5 Pro", "MacBook Pro (16-inch, M5 Pro, 2026)"),
    ("Mac17,7", "M5 Pro", "MacBook Pro (14-inch, M5 Pro, 2026)"),
    ("Mac17,8", "M5 Max", "MacBook Pro (16-inch, M5 Max, 2026)"),
    ("Mac17,9", "M5 Max", "MacBook Pro (14-inch, M5 Max, 2026)"),
    ("Mac17,5", "A18 Pro", "MacBook Neo (13-inch, 2026)"),
    ("VirtualMac2,1", "Virtual Mac", "Apple Virtual Machine"),
]

# Devices of kernel files named by board.
BOARD_KERNEL_DEVICES = {
    "kernelcache.release.mac13g": [
        "MacBookAir10,1", "MacBookPro17,1", "Macmini9,1", "iMac21,1", "iMac21,2",
    ],
    "kernelcache.release.mac13j": [
        "Mac13,1", "Mac13,2",
        "MacBookPro18,1", "MacBookPro18,2", "MacBookPro18,3", "MacBookPro18,4",
    ],
    "kernelcache.release.mac14g": ["Mac14,2", "Mac14,3", "Mac14,7", "Mac14,15"],
    "kernelcache.release.mac14j": [
        "Mac14,5", "Mac14,6", "Mac14,8", "Mac14,9",
        "Mac14,10", "Mac14,12", "Mac14,13", "Mac14,14",
    ],
    "kernelcache.release.vma2": ["VirtualMac2,1"],
}

# Fixed value: the shortest printable run.
MIN_RUN = 4

# Rules for binary artifacts as
# (name, path, fallback path, source, pattern, normalizer, normalizer arguments).
BINARY_RULES = [
    ("httpd", "usr/sbin/httpd", None, "filesystem",
     r"Apache/[0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["Apache/"]),
    ("curl", "usr/bin/curl", None, "filesystem",
     r"curl [0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["curl "]),
    ("LibreSSL", "usr/bin/openssl", None, "filesystem",
     r"LibreSSL [0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["LibreSSL "]),
    ("OpenSSH", "usr/bin/ssh", None, "filesystem",
     r"OpenSSH_[0-9]+\.[0-9]+p[0-9]+", "strip_prefix", ["OpenSSH_"]),
    ("Ruby", "usr/bin/ruby", None, "filesystem",
     r"[0-9]+\.[0-9]+\.[0-9]+p[0-9]+|ruby [0-9]+\.[0-9]+\.[0-9]+|[0-9]+\.[0-9]+\.[0-9]+",
     "strip_prefix", ["ruby "]),
    ("sudo", "usr/bin/sudo", None, "filesystem",
     r"[0-9]+\.[0-9]+\.[0-9]+(?:p[0-9]+)?", "identity", []),
    ("SQLite", "usr/bin/sqlite3", None, "filesystem",
     r"3\.[0-9]+\.[0-9]+", "identity", []),
    ("vim", "usr/bin/vim", None, "filesystem",
     r"VIM - Vi IMproved [0-9]+\.[0-9]+", "strip_prefix", ["VIM - Vi IMproved "]),
    ("zsh", "bin/zsh", None, "filesystem",
     r"zsh-[0-9]+\.[0-9]+", "strip_prefix", ["zsh-"]),
    ("libbz2 (bzip2)", "/usr/lib/libbz2.1.0.dylib", None, "dyldCache",
     r"1\.[0-9]+\.[0-9]+", "identity", []),
    ("libcurl", "/usr/lib/libcurl.4.dylib", None, "dyldCache",
     r"libcurl [0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["libcurl "]),
    ("libexpat", "/usr/lib/libexpat.1.dylib", None, "dyldCache",
     r"expat_[0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["expat_"]),
    ("libncurses", "/usr/lib/libncurses.5.4.dylib", None, "dyldCache",
     r"ncurses [0-9]+\.[0-9]+(?:\.[0-9]+)?", "strip_prefix", ["ncurses "]),
    ("libpcap", "/usr/lib/libpcap.A.dylib", None, "dyldCache",
     r"libpcap version [0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["libpcap version "]),
    ("libsqlite3", "/usr/lib/libsqlite3.dylib", None, "dyldCache",
     r"3\.[0-9]+\.[0-9]+", "identity", []),
    ("libssl (LibreSSL)", "/usr/lib/libssl.35.dylib", None, "dyldCache",
     r"LibreSSL [0-9]+\.[0-9]+\.[0-9]+", "strip_prefix", ["LibreSSL "]),
    ("libxml2", "/usr/lib/libxml2.2.dylib", None, "dyldCache",
     r"(?<!\d)2[01][0-9]{3}(?!\d)", "integer_version", []),
    ("Apple Clang", "usr/bin/clang", None, "filesystem",
     r"clang-[0-9]{3,}\.[0-9]+[0-9.]*", "strip_prefix", ["clang-"]),
    ("Swift", "usr/bin/swift-frontend", "usr/bin/swift", "filesystem",
     r"swiftlang-[0-9]{1,2}\.[0-9]+[0-9.]*|Swift version [0-9]+\.[0-9]+(?:\.[0-9]+)?",
     "truncate_version", ["swiftlang-", "Swift version "]),
    ("cctools", "usr/bin/otool", None, "filesystem",
     r"cctools-[0-9]+", "strip_prefix", ["cctools-"]),
    ("ld", "usr/bin/ld", None, "filesystem",
     r"PROJECT:(?:dyld|ld64|ld)-[0-9]+[0-9.]*",
     "strip_prefix", ["PROJECT:dyld-", "PROJECT:ld64-", "PROJECT:ld-"]),
    ("Git", "usr/bin/git", None, "filesystem",
     r"[0-9]+\.[0-9]+\.[0-9]+ \(Apple Git-[0-9]+[0-9.]*\)", "strip_vendor_suffix", []),
    ("lldb", "Contents/SharedFrameworks/LLDB.framework/LLDB", None, "filesystem",
     r"lldb-[0-9]+\.[0-9]+[0-9.]*", "strip_prefix", ["lldb-"]),
]

# Rules for header and stub texts as (name, path, pattern, normalizer, arguments).
# A ``multi_define`` rule has the names of its defines as arguments and no pattern.
TEXT_RULES = [
    ("bzip2", "lib/libbz2.1.0.tbd",
     r"current-version:\s*[0-9]+[0-9.]*", "current_version", []),
    ("expat", "include/expat.h", None, "multi_define",
     ["XML_MAJOR_VERSION", "XML_MINOR_VERSION", "XML_MICRO_VERSION"]),
    ("libcurl", "include/curl/curlver.h",
     r'#\s*define\s+LIBCURL_VERSION\s+"[^"]+"', "quoted_define", []),
    ("libexslt", "include/libexslt/exsltconfig.h",
     r"#\s*define\s+LIBEXSLT_VERSION\s+\d+", "integer_define", []),
    ("libffi", "include/ffi/ffi.h",
     r"libffi\s+[0-9]+\.[0-9]+[A-Za-z0-9.-]*", "strip_prefix", ["libffi "]),
    ("libxml2", "include/libxml/xmlversion.h",
     r'#\s*define\s+LIBXML_DOTTED_VERSION\s+"[^"]+"', "quoted_define", []),
    ("libxslt", "include/libxslt/xsltconfig.h",
     r'#\s*define\s+LIBXSLT_DOTTED_VERSION\s+"[^"]+"', "quoted_define", []),
    ("ncurses", "include/curses.h", None, "multi_define",
     ["NCURSES_VERSION_MAJOR", "NCURSES_VERSION_MINOR", "NCURSES_VERSION_PATCH"]),
    ("sqlite3", "include/sqlite3.h",
     r'#\s*define\s+SQLITE_VERSION\s+"[^"]+"', "quoted_define", []),
    ("zlib", "include/zlib.h",
     r'#\s*define\s+ZLIB_VERSION\s+"[^"]+"', "quoted_define", []),
]

# Bundled Python runtime, as component name, version pattern and source.
PYTHON_RULE = ("Python", r"^3\.(?:[2-9]|[1-9][0-9]+)\.[0-9]+$", "filesystem")

# Version strings of kernels.
KERNEL_DARWIN = r"Darwin Kernel Version (\d+\.\d+\.\d+)"
KERNEL_XNU = r"xnu-(\d+\.\d+\.\d+(?:\.\d+)*)"
KERNEL_ARCH = r"RELEASE_ARM64_([A-Za-z0-9]+)"

# Archive names that carry version and build.
ARCHIVE_NAME = r"UniversalMac_(\d+\.\d+(?:\.\d+)?)_([A-Za-z0-9]+)_Restore"

# Sections of change logs by commit type, in output order, and dropped types.
CHANGE_SECTIONS = {
    "feat": "What's New",
    "fix": "Fixes",
    "perf": "Performance",
    "refactor": "Under the Hood",
    "docs": "Documentation",
    "style": "Style",
    "test": "Testing",
}
CHANGE_DROPPED = ["build", "ci", "chore"]

# Quality rules of release documents and of the index, per product.
SHARED_REQUIRED = [
    "buildNumber", "osVersion", "releaseDate", "releaseName",
    "isBeta", "isRC", "productType", "components",
]
OPTIONAL_FIELDS = ["betaNumber", "betaRevision", "rcNumber"]
REQUIRED_FIELDS = {
    "macOS": [*SHARED_REQUIRED, "isDeviceSpecific", "ipswFile", "ipswURL", "kernels"],
    "Xcode": [*SHARED_REQUIRED, "xipFile", "xipURL", "minimumOSVersion", "sdks"],
}
BOOL_FIELDS = {"macOS": ["isBeta", "isRC", "isDeviceSpecific"], "Xcode": ["isBeta", "isRC"]}
FILE_FIELDS = {"macOS": ("ipswFile", "ipswURL"), "Xcode": ("xipFile", "xipURL")}
COMPONENT_SOURCES = {"macOS": ["filesystem", "dyldCache"], "Xcode": ["filesystem", "sdk"]}
COMPONENT_REQUIRED = ["name", "version", "path", "source"]
KERNEL_REQUIRED = ["arch", "chip", "darwinVersion", "xnuVersion", "file", "devices"]
INDEX_SHARED_REQUIRED = [
    "buildNumber", "osVersion", "releaseDate", "releaseName",
    "isBeta", "isRC", "productType", "dataFile",
]
INDEX_REQUIRED = {
    "macOS": [*INDEX_SHARED_REQUIRED, "isDeviceSpecific"],
    "Xcode": INDEX_SHARED_REQUIRED,
}
SHARED_PARITY = [
    "osVersion", "releaseDate", "releaseName", "isBeta", "isRC",
    "productType", "betaNumber", "betaRevision", "rcNumber",
]
PARITY_FIELDS = {"macOS": [*SHARED_PARITY, "isDeviceSpecific"], "Xcode": SHARED_PARITY}
VERSION_FORM = r"^\d+\.\d+(\.\d+)?$"
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"
OLDEST_YEAR = 2001
DOWNLOAD_HOST = "apple.com"
DOWNLOAD_HOST_SUFFIXES = [".apple.com", ".cdn-apple.com"]
ARCHIVE_URL = r"UniversalMac_([\d.]+)_([A-Za-z0-9]+)_Restore\.ipsw$"
NO_DEVICE_CHIP = "A12Z (DTK)"
NO_DEVICE_VM = "Virtual Mac"
NO_DEVICE_VM_BUILDS = ["21A5268h", "21A5284e", "21A5294g"]
RARE_BELOW = 3
RARE_MIN_RELEASES = 10
